"""Queries that write lines from the tables and read them back, or parse lines made in the query."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlake.operators import intervals as I
from turnlake.operators import joins as J
from turnlake.operators.shared import shared_dir
from turnlake.plans.views import LOCAL, SEGMENTS, TURNS, local, read, ref, segments, sql
from turnlake.sources import readers as R
from turnlake.sources import sinks as K
from turnlake.sources import tree
from turnlake.registry import query

MS = "(({us}) + 500) // 1000 * 1000"


@query("src_rttm_round_trip", sql(LOCAL, select=f"SELECT file_id, {MS.format(us='start_us')} AS start_us, {MS.format(us='start_us')} + {MS.format(us='end_us - start_us')} AS end_us, speaker FROM local"))
def src_rttm_round_trip(spark, d):
    lines = K.rttm_lines(local(spark, d)).select("value")
    noise = spark.range(3).select(F.lit(";; comment SPEAKER x").alias("value"))
    return R.rttm(lines.unionByName(noise))


@query("src_rttm_events", sql(LOCAL, select=f"SELECT file_id, {MS.format(us='start_us')} AS start_us, {MS.format(us='start_us')} + {MS.format(us='end_us - start_us')} AS end_us, speaker, 'speech' AS event_type FROM local"))
def src_rttm_events(spark, d):
    return R.rttm_events(K.rttm_lines(local(spark, d)).select("value"))


@query("src_stm_labelled", sql(TURNS, select="SELECT CAST(file_id AS VARCHAR) AS file_id, speaker, start_us, end_us, array_to_string(words, ' ') AS text FROM ref"))
def src_stm_labelled(spark, d):
    r = ref(spark, d).withColumn("text", F.array_join("words", " "))
    return R.stm(K.stm_lines(r, "<o,f0,unk>").select("value"))


@query("src_stm_strict", sql(TURNS, select="SELECT CAST(file_id AS VARCHAR) AS file_id, speaker, start_us, end_us, upper(replace(array_to_string(words[2:], ' '), 'ß', 'ss')) AS text FROM ref WHERE len(words) > 1"))
def src_stm_strict(spark, d):
    r = ref(spark, d).withColumn("text", F.array_join("words", " "))
    return R.stm(K.stm_lines(r).select("value"), has_label=True)


@query("src_transcript_json", sql(TURNS, select="SELECT file_id, start_us, end_us, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ref WHERE seg_id % 4 <> 3"))
def src_transcript_json(spark, d):
    s, e = K.decimal_seconds(F.col("start_us")), K.decimal_seconds(F.col("end_us"))
    usual = F.to_json(F.struct(s.alias("start"), e.alias("end"), "speaker", "text"))
    other = F.to_json(F.struct(s.alias("start_time"), e.alias("finish"), F.col("speaker").alias("spk"), F.col("text").alias("utterance")))
    lines = ref(spark, d).select("file_id", F.when(F.col("seg_id") % 4 == 3, F.to_json(F.struct(s.alias("start"), "text"))).when(F.col("seg_id") % 2 == 0, usual).otherwise(other).alias("value"))
    return R.transcript_json(lines)


@query("src_precedence", sql(TURNS, select="SELECT file_id, seg_id, CASE file_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'transcript' ELSE 'stm' END AS origin FROM ref"))
def src_precedence(spark, d):
    r = ref(spark, d).select("file_id", "seg_id")
    parts = [r.where("file_id % 3 = 0").withColumn("origin", F.lit("dataset")), r.where("file_id % 3 <= 1").withColumn("origin", F.lit("transcript")), r.withColumn("origin", F.lit("stm"))]
    return R.first_source(*parts)


@query("src_bracket", sql(TURNS, select="SELECT file_id, start_us, end_us, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ref"))
def src_bracket(spark, d):
    s, e = K.decimal_seconds(F.col("start_us"), 1), K.decimal_seconds(F.col("end_us"), 1)
    return R.bracket(ref(spark, d).select("file_id", F.format_string("[%ss - %ss] %s: %s", s, e, "speaker", F.trim(F.regexp_replace("text", r"\s+", " "))).alias("value")))


@query("src_annotator", sql(TURNS, select="SELECT file_id, start_us, end_us, speaker, array_to_string(words, ' ') AS text FROM ref WHERE NOT contains(array_to_string(words, ' '), '|')"))
def src_annotator(spark, d):
    s, e = K.decimal_seconds(F.col("start_us"), 2), K.decimal_seconds(F.col("end_us"), 2)
    r = ref(spark, d).withColumn("t", F.array_join("words", " ")).where("not contains(t, '|')")
    return R.annotator(r.select("file_id", F.format_string("[%ss - %ss] Text: | %s | %s", s, e, "speaker", "t").alias("value")))


@query("src_webvtt", sql(TURNS, select="SELECT file_id, start_us, end_us, array_to_string(words, ' ') AS text FROM ref WHERE NOT regexp_matches(array_to_string(words, ' '), '[<>\\[\\]]')"))
def src_webvtt(spark, d):
    stamp = lambda c: F.format_string("%02d:%02d:%02d.%03d", F.floor(F.col(c) / 3_600_000_000), F.floor(F.col(c) / 60_000_000) % 60, F.floor(F.col(c) / 1_000_000) % 60, F.floor(F.col(c) / 1000) % 1000)
    r = ref(spark, d).withColumn("t", F.array_join("words", " ")).where(~F.col("t").rlike(r"[<>\[\]]"))
    cues = r.select("file_id", F.struct("start_us", F.concat(stamp("start_us"), F.lit(" --> "), stamp("end_us"), F.lit("\n<c>"), "t", F.lit("</c>\n[music]")).alias("c")).alias("c"))
    files = cues.groupBy("file_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["c"]), "\n\n")).alias("value"))
    return R.webvtt(files)


@query("src_class_table", "SELECT c_name AS name, c_mktsegment AS class_name, CAST(c_nationkey AS VARCHAR) AS speakers, CAST(c_custkey AS VARCHAR) AS episode FROM customer")
def src_class_table(spark, d):
    c = read(spark, d, "customer")
    line = lambda cls: F.concat_ws(" | ", "c_name", cls, F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("value")
    return R.class_table(c.select(line(F.lit("old")), F.lit(1).alias("line_no")).unionByName(c.select(line(F.col("c_mktsegment")), F.lit(2).alias("line_no"))))


@query("src_overlap_table", "SELECT p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS overlap, CAST(p_partkey % 7 AS INTEGER) AS n_speakers, CAST(p_partkey AS INTEGER) AS episode FROM part WHERE p_partkey % 3 <> 0")
def src_overlap_table(spark, d):
    k = F.col("p_partkey")
    overlap, n = F.when(k % 5 == 0, F.lit("bad")).otherwise(F.col("p_size").cast("string")), F.when(k % 3 == 0, F.lit("?")).otherwise((k % 7).cast("string"))
    return R.overlap_table(read(spark, d, "part").select(F.concat_ws(" | ", "p_name", overlap, n, k.cast("string")).alias("value")))


@query("src_metadata_cases", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'data' || CAST(o_orderkey % 20 + 1 AS VARCHAR) ELSE 'data' || CAST(o_orderkey % 20 AS VARCHAR) END AS case_id FROM orders")
def src_metadata_cases(spark, d):
    k = F.col("o_orderkey")
    case = F.concat(F.lit("data"), (k % 20).cast("string"))
    other = F.concat(F.lit("data"), (k % 20 + 1).cast("string"))
    line = F.when(k % 3 == 0, F.to_json(F.struct(case.alias("case_id"), F.lit("10%").alias("overlap_pct")))).when(k % 3 == 1, F.concat(F.lit("case="), case, F.lit(" spk:3"))).otherwise(F.concat(F.lit("note=see_"), F.lit(" path:/x/"), other, F.lit("/a")))
    known = spark.range(21).select(F.concat(F.lit("data"), F.col("id").cast("string")).alias("case_id"))
    records = R.record_maps(read(spark, d, "orders").select("o_orderkey", line.alias("value")))
    return R.case_of(records, known, ["case_id", "case"]).select("o_orderkey", "case_id")


DIALECTS = """WITH o AS (SELECT o_custkey AS f, o_orderkey AS k, 'data' || CAST(o_orderkey % 20 AS VARCHAR) AS c, CAST(o_orderkey % 7 AS VARCHAR) AS m, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
 x AS (SELECT *, CASE WHEN f % 3 = 0 AND k % 4 <> 0 THEN 0 WHEN f % 3 = 1 AND i = 1 THEN NULL WHEN f % 3 = 1 AND k % 5 <> 0 THEN 1 ELSE 5 END AS lv FROM o), b AS (SELECT f, MIN(lv) AS lv FROM x GROUP BY f)
 SELECT x.f AS file, c AS case_id, CAST(x.lv AS INTEGER) AS dialect, ARG_MAX(CASE WHEN x.lv = 5 THEN m || ' ' || c ELSE m END, k) AS spk FROM x JOIN b ON x.f = b.f AND x.lv = b.lv GROUP BY x.f, c, x.lv"""


@query("src_metadata_dialects", DIALECTS)
def src_metadata_dialects(spark, d):
    """A metadata file a customer, a line an order: JSON, a table or free text, with free lines in all of them."""
    k, file = F.col("o_orderkey"), F.col("o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("i"), F.concat(F.lit("data"), (k % 20).cast("string")).alias("case"), (k % 7).cast("string").alias("spk"))
    # With a comma it would be a table under its first line.
    free = F.concat(F.lit("spk: "), "spk", F.lit(" "), "case")
    value = (
        F.when((file % 3 == 0) & (k % 4 != 0), F.to_json(F.struct(F.col("case").alias("case_id"), "spk")))
        .when((file % 3 == 1) & (F.col("i") == 1), F.lit("case_id | spk"))
        .when((file % 3 == 1) & (k % 5 != 0), F.concat_ws(" | ", "case", "spk"))
        .otherwise(free)
    )
    known = spark.range(20).select(F.concat(F.lit("data"), F.col("id").cast("string")).alias("case_id"))
    found = R.metadata(orders.select(file.alias("file"), k.alias("line_no"), value.alias("value")), known, ["case_id", "case"])
    return found.select("file", "case_id", "dialect", F.col("record")["spk"].alias("spk"))


@query("src_predictions", "SELECT 'rec_' || CAST(user_id % 4 AS VARCHAR) AS data_name, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE CAST(user_id % 4 AS VARCHAR) END AS speaker, event_id * 1000000 AS start_us, event_id * 1000000 + 500000 AS end_us, event_type AS text, event_id % 3 = 0 AS was_retried FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def src_predictions(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select(
        F.concat(F.lit("rec_"), (F.col("user_id") % 4).cast("string")).alias("data_name"),
        F.when(e % 2 == 0, F.lit("x")).otherwise(F.lit("")).alias("speaker"),
        F.when(e % 7 == 0, F.lit("oops")).otherwise(e.cast("string")).alias("start"),
        F.concat(e.cast("string"), F.lit(".5")).alias("end"),
        F.when(e % 11 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("predicted_text"),
        F.when(e % 3 == 0, F.lit("True")).otherwise(F.lit("False")).alias("was_retried"),
    )
    return R.predictions(rows)


@query("src_alignments", "SELECT CAST(conv_id AS VARCHAR) AS audio_id, MAX(turn) AS n FROM conversations GROUP BY conv_id")
def src_alignments(spark, d):
    c = read(spark, d, "conversations")
    word = F.struct(F.lit("w").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(1.0).alias("duration"))
    j = F.to_json(F.struct(F.lit("f").alias("file"), F.concat(F.col("conv_id").cast("string"), F.lit(".wav")).alias("audio_id"), F.array_repeat(word, F.col("turn").cast("int")).alias("words")))
    files = c.select(j.alias("value"), F.format_string("%06d", "turn").alias("path"))
    return R.alignments(files).select("audio_id", F.size("words").cast("long").alias("n"))


@query("src_prompts", "SELECT 'common_voice_vi_' || CAST(user_id AS VARCHAR) || CAST(event_id AS VARCHAR) AS id, event_type AS text FROM events")
def src_prompts(spark, d):
    line = F.format_string("speaker%d_%d\t%s", "user_id", "event_id", "event_type")
    return R.prompts(read(spark, d, "events").select(line.alias("value")))


@query("src_file_choice", "SELECT CAST(p_partkey AS VARCHAR) AS folder, CASE WHEN p_partkey % 2 = 0 THEN 'mixture.wav' ELSE 'audio.flac' END AS audio FROM part")
def src_file_choice(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("folder"), "p_partkey")
    listing = p.where("p_partkey % 2 = 0").select("folder", F.lit("mixture.wav").alias("file")).unionByName(p.select("folder", F.lit("audio.flac").alias("file"))).unionByName(p.select("folder", F.lit("notes.txt").alias("file")))
    return R.files_by_folder(listing, ["mixture.wav", "mixture.flac", "audio.wav", "audio.flac"], "audio")


@query("src_checkpoints", "SELECT 'ep' || lpad(CAST(l AS VARCHAR), 3, '0') AS label, 2 AS kind, CAST(l AS INTEGER) AS epoch, 'ep' || lpad(CAST(l AS VARCHAR), 3, '0') || '.ckpt' AS file FROM (SELECT DISTINCT l_linenumber AS l FROM lineitem) UNION ALL SELECT 'best_model', 1, 0, 'best_model.bin' UNION ALL SELECT 'baseline', 0, 0, 'baseline.pt'")
def src_checkpoints(spark, d):
    eps = read(spark, d, "lineitem").select(F.format_string("ep%03d.ckpt", "l_linenumber").alias("file")).distinct()
    return R.checkpoints(eps.unionByName(spark.createDataFrame([("best_model.bin",), ("baseline.pt",)], "file string")))


@query("src_segment_scan", sql(LOCAL, "n AS (SELECT *, CAST(GREATEST(1, (end_us - start_us + 28999999) // 29000000) AS INTEGER) AS parts FROM local WHERE speaker <> '3'), p AS (SELECT *, unnest(range(0, parts)) AS part FROM n), q AS (SELECT seg_id, start_us + (end_us - start_us) * part // parts AS a, start_us + (end_us - start_us) * (part + 1) // parts AS b FROM p)", select="SELECT seg_id, GREATEST(0, a - 100000) AS start_us, LEAST(86400000000, b + 200000) AS end_us FROM q WHERE b - a >= 500000"))
def src_segment_scan(spark, d):
    """Segments without unknown speakers, split, filtered by length and padded."""
    cut = I.split_long(local(spark, d).where("speaker <> '3'"), 29_000_000).where("end_us - start_us >= 500000")
    return cut.select("seg_id", *I.pad(100_000, 200_000, F.lit(86_400_000_000)))


@query("sink_rttm_text", sql(LOCAL, select="SELECT file_id, printf('SPEAKER %s 1 %d.%03d %d.%03d <NA> <NA> %s <NA> <NA>', file_id, (start_us + 500) // 1000000, (start_us + 500) // 1000 % 1000, (end_us - start_us + 500) // 1000000, (end_us - start_us + 500) // 1000 % 1000, speaker) AS value FROM local"))
def sink_rttm_text(spark, d):
    return K.rttm_lines(local(spark, d)).select("file_id", "value")


@query("sink_ctm", sql(TURNS, "w AS (SELECT file_id, start_us, end_us, CAST(unnest(range(0, len(words))) AS INTEGER) AS pos, len(words) AS n, words FROM ref), pw AS (SELECT file_id, words[pos + 1] AS word, start_us + (end_us - start_us) * pos // n AS a, start_us + (end_us - start_us) * (pos + 1) // n AS b FROM w)", select="SELECT file_id, printf('%s 1 %d.%02d %d.%02d %s', CAST(file_id AS VARCHAR), (a + 5000) // 1000000, (a + 5000) // 10000 % 100, (b - a + 5000) // 1000000, (b - a + 5000) // 10000 % 100, upper(replace(word, 'ß', 'ss'))) AS value FROM pw"))
def sink_ctm(spark, d):
    return K.ctm_lines(I.project_words(ref(spark, d)).withColumn("file_id", F.col("file_id").cast("string"))).select(F.col("file_id").cast("long").alias("file_id"), "value")


@query("sink_export_index", sql(SEGMENTS, select="SELECT seg_id, speaker || '/' || printf('%05d', ROW_NUMBER() OVER (PARTITION BY speaker ORDER BY start_us, end_us, seg_id)) AS path FROM segments"))
def sink_export_index(spark, d):
    return I.reindex(segments(spark, d), ("speaker",)).select("seg_id", F.concat("speaker", F.lit("/"), F.format_string("%05d", "idx")).alias("path"))


@query("sink_manifest_counts", "SELECT 'stage' || CAST(n_chars % 4 + 1 AS VARCHAR) AS stage, lang AS split, COUNT(*) AS n FROM documents GROUP BY ALL")
def sink_manifest_counts(spark, d):
    samples = read(spark, d, "documents").withColumn("stage", F.concat(F.lit("stage"), (F.col("n_chars") % 4 + 1).cast("string")))
    return samples.groupBy("stage", F.col("lang").alias("split")).agg(F.count("*").alias("n"))


@query("src_tree", sql(LOCAL, select=f"SELECT file_id, speaker, {MS.format(us='start_us')} AS start_us, {MS.format(us='start_us')} + {MS.format(us='end_us - start_us')} AS end_us FROM local WHERE file_id >= '2024-01-10'"))
def src_tree(spark, d):
    """Segments written as a tree of RTTM files and read by the recording_tree format; folders before a day are not
    opened."""
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    K.write_lines(K.rttm_lines(local(spark, d)), path)
    tree.register(spark)
    lines = spark.read.format(tree.FORMAT).load(path).where("file_id >= '2024-01-10'")
    return R.rttm(lines, key="file_id").select("file_id", "speaker", "start_us", "end_us")
