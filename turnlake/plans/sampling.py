"""Queries of dedup, sampling, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import dedup as D
from turnlake.operators import folds as O
from turnlake.operators import joins as J
from turnlake.operators import ranking as R
from turnlake.operators import sampling as P
from turnlake.plans.views import TURNS, hyp_lines, read, ref, segments, sql
from turnlake.registry import query


@query("dd_exact", "SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY md5(concat_ws('||', source, text)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dd_exact(spark, d):
    return D.exact(read(spark, d, "documents"), [F.col("source"), F.col("text")], ["doc_id"]).select("doc_id")


@query("dd_limit_reuse", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n <= 2")
def dd_limit_reuse(spark, d):
    return D.limit_reuse(read(spark, d, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("dd_first_seen", "SELECT MIN(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def dd_first_seen(spark, d):
    return R.first_per_key(read(spark, d, "documents"), ["source", "lang"], ["doc_id"]).select("doc_id", "source", "lang")


@query("dd_representatives", "SELECT 'b' AS label, MIN(c_custkey) AS c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build') UNION ALL SELECT 'm', MIN(c_custkey) FROM customer WHERE contains(lower(c_mktsegment), 'mach') OR contains(lower(c_mktsegment), 'auto')")
def dd_representatives(spark, d):
    rows = read(spark, d, "customer").withColumn("g", F.lower("c_mktsegment"))
    return D.representatives(rows, "g", {"b": ["build"], "m": ["mach", "auto"]}, ["c_custkey"], "c_custkey").select("label", "c_custkey")


@query("dd_near_pairs", sql(TURNS, "x AS (SELECT file_id, seg_id, start_us, end_us, words FROM ref), y AS (SELECT file_id, seg_id, start_us + 300000 AS start_us, end_us + 300000 AS end_us, words FROM ref)", select="SELECT x.file_id, x.seg_id AS a, y.seg_id AS b FROM x JOIN y ON x.file_id = y.file_id AND x.start_us < y.end_us AND y.start_us < x.end_us WHERE abs(x.start_us - y.start_us) + abs(x.end_us - y.end_us) < 1000000 AND len(list_intersect(list_distinct(x.words), list_distinct(y.words)))::DOUBLE / GREATEST(len(list_distinct(x.words)), len(list_distinct(y.words))) > 0.8"))
def dd_near_pairs(spark, d):
    from turnlake.operators.metrics import token_similarity

    x = ref(spark, d).select("file_id", "seg_id", "start_us", "end_us", "words")
    y = x.withColumns({"start_us": F.col("start_us") + 300_000, "end_us": F.col("end_us") + 300_000})
    pairs = J.range_join(x, J.right_side(y, ["file_id"]), ["file_id"]).where("abs(start_us - r_start_us) + abs(end_us - r_end_us) < 1000000")
    return pairs.where(token_similarity("words", "r_words") > 0.8).select("file_id", F.col("seg_id").alias("a"), F.col("r_seg_id").alias("b"))


@query("smp_split", "SELECT doc_id, CASE WHEN rk <= GREATEST(0, LEAST(floor(n * 10 / 100.0), n - 1)) THEN 'val' ELSE 'train' END AS part FROM (SELECT doc_id, COUNT(*) OVER (PARTITION BY source) AS n, ROW_NUMBER() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS rk FROM documents)")
def smp_split(spark, d):
    return P.split_train_val(read(spark, d, "documents"), ["source"], "doc_id", 10).select("doc_id", "part")


@query("smp_round_robin", "SELECT doc_id FROM (SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) ORDER BY r, lang LIMIT 50")
def smp_round_robin(spark, d):
    return P.round_robin(read(spark, d, "documents"), ["lang"], "doc_id", 50).select("doc_id")


@query("smp_round_robin_two", "SELECT doc_id FROM (SELECT doc_id, source, k, ROW_NUMBER() OVER (PARTITION BY source, k ORDER BY doc_id) AS r FROM (SELECT doc_id, source, LEAST(n_chars % 6, 4) AS k FROM documents)) ORDER BY r, source, k LIMIT 60")
def smp_round_robin_two(spark, d):
    rows = read(spark, d, "documents").withColumn("k", F.least(F.col("n_chars") % 6, F.lit(4)))
    return P.round_robin(rows, ["source", "k"], "doc_id", 60).select("doc_id")


@query("smp_until_target", "SELECT doc_id FROM (SELECT doc_id, COALESCE(SUM(n_chars) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000")
def smp_until_target(spark, d):
    return P.until_target(read(spark, d, "documents"), ["source"], "doc_id", "n_chars", F.lit(20_000)).select("doc_id")


@query("smp_per_group", "SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS n FROM documents) WHERE n <= 10")
def smp_per_group(spark, d):
    return P.per_group(read(spark, d, "documents"), ["source"], "doc_id", 10).select("doc_id")


@query("smp_with_replacement")
def smp_with_replacement(spark, d):
    return P.with_replacement(read(spark, d, "documents").select("doc_id", "source"), "source", F.lit(1.0), 1000)


@query("smp_stage_manifest", "WITH parents AS (SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, COALESCE(SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 500000) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem l WHERE l_discount <= 0.05 AND l_orderkey IN (SELECT o_orderkey FROM parents)) WHERE n <= 2")
def smp_stage_manifest(spark, d):
    parents = P.until_target(read(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", "o_custkey", F.lit(500_000)).select(F.col("o_orderkey").alias("l_orderkey"))
    samples = read(spark, d, "lineitem").where("l_discount <= 0.05").join(parents, "l_orderkey", "left_semi")
    return D.limit_reuse(samples, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _lines(spark, d):
    return ref(spark, d).select("file_id", "seg_id", "start_us", "end_us", "speaker", F.array_join("words", " ").alias("text"))


def _speech(spark, d):
    return segments(spark, d).withColumn("text", F.concat(F.lit("w"), (F.col("seg_id") % 5).cast("string")))


@query("fold_chunks")
def fold_chunks(spark, d):
    return O.per_recording(_speech(spark, d), lambda rows: O.build_chunks(rows, O.ChunkSpec(), [(r.start, r.end, r.speaker) for r in rows]))


@query("fold_merge_short")
def fold_merge_short(spark, d):
    return O.per_recording(_speech(spark, d), lambda rows: O.merge_short(rows, O.ChunkSpec()))


@query("fold_merge_adjacent")
def fold_merge_adjacent(spark, d):
    return O.per_recording(_speech(spark, d), O.merge_adjacent_speaker)


@query("fold_turn_groups")
def fold_turn_groups(spark, d):
    return O.per_recording(_lines(spark, d), O.turn_groups)


@query("fold_near_copies")
def fold_near_copies(spark, d):
    return O.per_recording(_speech(spark, d), O.drop_near_copies)


@query("fold_repeated_lines")
def fold_repeated_lines(spark, d):
    moved = hyp_lines(spark, d).select("file_id", F.col("hyp_id").alias("seg_id"), "start_us", "end_us", "speaker", F.array_join("words", " ").alias("text"))
    return O.per_recording(_lines(spark, d).unionByName(moved), O.drop_repeated_lines)


@query("fold_retime")
def fold_retime(spark, d):
    """Slots drawn together: gaps shrink to 45 %, lengths to 80 %."""

    def fold(rows):
        moved = O.retime([(r.start, r.end, (r.end - r.start) * 8 // 10) for r in rows])
        return [O.Seg(a, b, r.speaker, r.text) for (a, b), r in zip(moved, rows, strict=True)]

    return O.per_recording(_speech(spark, d), fold)


@query("fold_word_times")
def fold_word_times(spark, d):
    """Word times of turns moved into each other, relaxed; back in microseconds."""

    def fold(rows):
        seconds = [O.Seg(r.start / 1e6, r.end / 1e6, r.speaker, r.text) for r in rows]
        return [O.Seg(round(s.start * 1e6), round(s.end * 1e6), s.speaker, s.text) for s in O.clean_word_times(seconds)]

    lines = _lines(spark, d)
    return O.per_recording(lines.withColumn("end_us", F.col("end_us") + (F.col("seg_id") % 3 - 1) * 400_000), fold)


@query("dd_capped_use")
def dd_capped_use(spark, d):
    """Lines of a recording, each word of five letters and more in two lines at most."""

    def fold(rows):
        kept = set(O.capped_use([(str(k), sorted({w for w in r.text.split() if len(w) >= 5})) for k, r in enumerate(rows)]))
        return [r for k, r in enumerate(rows) if str(k) in kept]

    return O.per_recording(_lines(spark, d), fold)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("src_files", f"SELECT unnest({[t + '.parquet' for t in TABLES]}) AS file")
def src_files(spark, d):
    """Tables of the data folder, files or folders of parts, from a listing that reads no contents."""
    from turnlake.sources.readers import list_files

    listed = list_files(spark, d).select(F.when(F.col("folder").endswith(".parquet"), F.col("folder")).otherwise(F.col("file")).alias("file"))
    return listed.where(F.col("file").endswith(".parquet")).distinct()
