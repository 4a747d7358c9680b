"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import joins as J
from turnlake.plans.views import HYP, HYP_LINES, SEGMENTS, TURNS, hyp, hyp_lines, read, ref, segments, sql
from turnlake.registry import query

MATCHES = """m AS (SELECT h.hyp_id, h.start_us, h.end_us, r.start_us AS rs, r.end_us AS re, r.seg_id AS ref_id, r.words AS rw, LEAST(h.end_us, r.end_us) - GREATEST(h.start_us, r.start_us) AS ov, GREATEST(1, r.end_us - r.start_us) AS dur,
 CASE WHEN h.speaker = r.speaker AND h.speaker <> '' THEN 1 ELSE 0 END AS same FROM hypl h JOIN ref r ON h.file_id = r.file_id AND h.start_us < r.end_us AND r.start_us < h.end_us),
 k AS (SELECT *, MAX(same) OVER (PARTITION BY hyp_id) AS best FROM m WHERE ov >= 200000 OR ov * 5 >= dur),
 w AS (SELECT *, CAST((GREATEST(start_us, rs) - rs) * len(rw) // dur AS BIGINT) AS w0, CAST((LEAST(end_us, re) - rs) * len(rw) // dur AS BIGINT) AS w1a FROM k WHERE same = best),
 x AS (SELECT *, LEAST(GREATEST(w0 + 1, w1a), len(rw)) AS w1 FROM w),
 p AS (SELECT hyp_id, rs, ref_id, CASE WHEN ov * 100 >= dur * 80 THEN rw ELSE rw[w0 + 1:w1] END AS part FROM x),
 a AS (SELECT hyp_id, flatten(list(part ORDER BY rs, ref_id)) AS ref_words, COUNT(*) AS n_matches FROM p GROUP BY hyp_id),
 assigned AS (SELECT h.hyp_id, h.file_id, h.speaker, h.words, COALESCE(a.ref_words, []) AS ref_words, COALESCE(a.n_matches, 0) AS n_matches FROM hypl h LEFT JOIN a ON h.hyp_id = a.hyp_id)"""


def assigned(spark, d):
    r = ref(spark, d).withColumnRenamed("seg_id", "ref_id").select("file_id", "ref_id", "speaker", "start_us", "end_us", "words")
    return J.assign_reference(hyp_lines(spark, d), r, ["file_id"])


@query("join_assign_reference", sql(HYP_LINES, MATCHES, select="SELECT hyp_id, array_to_string(ref_words, ' ') AS ref_text, n_matches FROM assigned"))
def join_assign_reference(spark, d):
    return assigned(spark, d).select("hyp_id", F.array_join("ref_words", " ").alias("ref_text"), "n_matches")


@query("join_aligned_text", sql(TURNS, "q AS (SELECT file_id, seg_id, start_us + 1300000 AS start_us, end_us + 1300000 AS end_us, file_id * 1000 + seg_id AS id FROM ref)", select="""SELECT q.id, COALESCE(STRING_AGG(r.text, ' ' ORDER BY r.start_us, r.end_us, r.text) FILTER (WHERE r.seg_id IS NOT NULL), 'none') AS aligned FROM q LEFT JOIN ref r ON q.file_id = r.file_id AND q.start_us < r.end_us AND r.start_us < q.end_us
 AND (LEAST(q.end_us, r.end_us) - GREATEST(q.start_us, r.start_us) > 500000 OR (LEAST(q.end_us, r.end_us) - GREATEST(q.start_us, r.start_us)) * 100 > (r.end_us - r.start_us) * 40) GROUP BY q.id"""))
def join_aligned_text(spark, d):
    r = ref(spark, d)
    q = r.select("file_id", (F.col("file_id") * 1000 + F.col("seg_id")).alias("id"), (F.col("start_us") + 1_300_000).alias("start_us"), (F.col("end_us") + 1_300_000).alias("end_us")).withColumn("none", F.lit("none"))
    return J.aligned_text(q, r.select("file_id", "start_us", "end_us", "text"), ["file_id"], "id", "none").select("id", "aligned")


@query("join_best_speaker", sql(HYP, """p AS (SELECT h.seg_id, s.speaker, ROW_NUMBER() OVER (PARTITION BY h.seg_id ORDER BY LEAST(h.end_us, s.end_us) - GREATEST(h.start_us, s.start_us) DESC, s.start_us, s.seg_id) AS n FROM hyp h JOIN segments s ON h.file_id = s.file_id AND h.start_us < s.end_us AND s.start_us < h.end_us)""", select="SELECT h.seg_id, COALESCE(p.speaker, 'Unknown') AS assigned FROM hyp h LEFT JOIN p ON h.seg_id = p.seg_id AND p.n = 1"))
def join_best_speaker(spark, d):
    return J.best_overlap_speaker(hyp(spark, d), segments(spark, d), ["file_id"], "seg_id").select("seg_id", "assigned")


@query("join_rounded_start", sql(SEGMENTS, "b AS (SELECT file_id, (start_us + 5000) // 10000 AS cs, ARG_MAX(speaker, seg_id) AS spk FROM segments GROUP BY ALL)", select="SELECT s.seg_id, COALESCE(b.spk, 'Unknown') AS mapped FROM segments s LEFT JOIN b ON s.file_id = b.file_id AND (s.start_us + (s.seg_id % 3) * 1000000 + 5000) // 10000 = b.cs"))
def join_rounded_start(spark, d):
    s = segments(spark, d)
    table = J.last_per_key(s.select("file_id", F.expr("(start_us + 5000) div 10000").alias("cs"), "speaker", "seg_id"), ["file_id", "cs"], "speaker", "seg_id").withColumnRenamed("speaker", "mapped")
    left = s.select("seg_id", "file_id", F.expr("(start_us + (seg_id % 3) * 1000000 + 5000) div 10000").alias("cs"))
    return J.lookup(left, table, ["file_id", "cs"], {"mapped": "Unknown"}).select("seg_id", "mapped")


@query("join_evidence", sql(SEGMENTS, "item AS (SELECT file_id, CAST(user_id % 4 AS VARCHAR) AS speaker, event_id AS item_id, epoch_us(ts) + 7000000 AS a, epoch_us(ts) + 9000000 AS b, CAST(CAST(ts AS DATE) AS VARCHAR) AS f FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS file_id FROM events))", select="SELECT item_id FROM item i WHERE EXISTS (SELECT 1 FROM segments s WHERE s.file_id = i.f AND s.speaker = i.speaker AND NOT (s.end_us < i.a OR i.b < s.start_us))"))
def join_evidence(spark, d):
    s = segments(spark, d)
    spans = s.select(F.col("seg_id").alias("item_id"), "file_id", "speaker", (F.col("start_us") + 7_000_000).alias("start_us"), (F.col("start_us") + 9_000_001).alias("end_us"))
    closed = s.withColumn("end_us", F.col("end_us") + 1)  # closed ends meet where half-open ones of one more do
    return J.range_join(spans, J.right_side(closed, ["file_id"]), ["file_id"]).where("speaker = r_speaker").select("item_id").distinct()


@query("join_metadata_lookup", "SELECT o_orderkey, COALESCE(c_mktsegment, 'unknown') AS class_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey")
def join_metadata_lookup(spark, d):
    classes = read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("class_name"))
    return J.lookup(read(spark, d, "orders"), classes, ["o_custkey"], {"class_name": "unknown"}).select("o_orderkey", "class_name")


@query("join_skipped_recordings", sql(HYP_LINES, select="SELECT DISTINCT file_id FROM hypl h WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.file_id = h.file_id AND r.file_id % 5 <> 0)"))
def join_skipped_recordings(spark, d):
    return hyp_lines(spark, d).join(ref(spark, d).where("file_id % 5 <> 0").select("file_id"), "file_id", "left_anti").select("file_id").distinct()


@query("join_common_speakers", "SELECT a.conv_id, a.role, a.n AS n_first, b.n AS n_second FROM (SELECT conv_id, role, COUNT(*) AS n FROM conversations WHERE turn < 2 GROUP BY ALL) a JOIN (SELECT conv_id, role, COUNT(*) AS n FROM conversations WHERE turn >= 2 GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.role = b.role")
def join_common_speakers(spark, d):
    c = read(spark, d, "conversations")
    first = c.where("turn < 2").groupBy("conv_id", "role").agg(F.count("*").alias("n_first"))
    return first.join(c.where("turn >= 2").groupBy("conv_id", "role").agg(F.count("*").alias("n_second")), ["conv_id", "role"])


@query("join_prompt_lookup", "SELECT d.doc_id, b.text AS prompt FROM documents d JOIN benchmark b ON d.doc_id % 37 = b.item_id")
def join_prompt_lookup(spark, d):
    prompts = read(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("prompt"))
    return read(spark, d, "documents").withColumn("key", F.col("doc_id") % 37).join(prompts, "key").select("doc_id", "prompt")


GRID = "grid AS (SELECT DISTINCT a.l_returnflag AS checkpoint, b.l_linestatus AS split, c.t AS threshold_bp FROM (SELECT DISTINCT l_returnflag FROM lineitem) a, (SELECT DISTINCT l_linestatus FROM lineitem) b, (SELECT unnest(range(500, 4501, 1000)) AS t) c)"


@query("join_task_grid", sql(GRID, select="SELECT * FROM grid"))
def join_task_grid(spark, d):
    from turnlake.operators.sweep import task_grid

    runs = read(spark, d, "lineitem")
    return task_grid(runs.select(F.col("l_returnflag").alias("checkpoint")), runs.select(F.col("l_linestatus").alias("split")), spark.range(500, 4501, 1000).select(F.col("id").alias("threshold_bp")))


@query("join_resume", sql(GRID, select="SELECT * FROM grid WHERE NOT (checkpoint = 'A' AND threshold_bp < 2000)"))
def join_resume(spark, d):
    from turnlake.operators.sweep import remaining

    grid = join_task_grid(spark, d)
    return remaining(grid, grid.where("checkpoint = 'A' and threshold_bp < 2000"), ["checkpoint", "split", "threshold_bp"])


@query("join_noise_map", "SELECT p_partkey, p_size % 5 AS noise FROM part WHERE p_size % 5 < 4")
def join_noise_map(spark, d):
    noise = spark.range(4).select(F.col("id").cast("int").alias("noise"))
    return read(spark, d, "part").withColumn("noise", F.col("p_size") % 5).join(noise, "noise").select("p_partkey", "noise")


@query("join_chosen_parents", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount <= 0.05 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_chosen_parents(spark, d):
    chosen = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").where("l_discount <= 0.05").join(chosen, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")
