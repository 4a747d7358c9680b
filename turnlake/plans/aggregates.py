"""Queries of the rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import aggregates as A
from turnlake.operators import ranking as R
from turnlake.operators import sweep as W
from turnlake.plans.views import SEGMENTS, read, segments, sql
from turnlake.registry import query


@query("agg_wer_rollup", """SELECT l_returnflag AS grp, CAST(l_shipdate AS DATE) AS file, CAST(SUM(l_linenumber) AS BIGINT) AS edits, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_words, COUNT(*) AS n_segments, CAST(GROUPING_ID(l_returnflag, CAST(l_shipdate AS DATE)) AS INTEGER) AS level,
 CAST(SUM(l_linenumber) AS DOUBLE) / GREATEST(CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE), 1) AS wer FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, CAST(l_shipdate AS DATE)), (l_returnflag), ())""")
def agg_wer_rollup(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_shipdate").cast("date").alias("file"), F.col("l_linenumber").cast("long").alias("edits"), F.col("l_quantity").cast("long").alias("n_words"))
    return A.wer_rollup(rows, "file", "grp")


@query("agg_mean_of_means", "SELECT COUNT(*) AS cases, AVG(s) AS score, AVG(t) AS tax FROM (SELECT l_suppkey, AVG(COALESCE(CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END, 0)) AS s, AVG(CAST(l_linenumber AS DOUBLE)) AS t FROM lineitem GROUP BY l_suppkey)")
def agg_mean_of_means(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("score"), F.col("l_linenumber").cast("double").alias("tax"))
    return A.mean_of_means(rows, "l_suppkey", ["score", "tax"])


@query("agg_unique_issues", "SELECT event_type AS issue, MIN(event_id) AS event_id FROM events GROUP BY event_type")
def agg_unique_issues(spark, d):
    from turnlake.operators.dedup import unique_in_order

    return unique_in_order(read(spark, d, "events").select(F.col("event_type").alias("issue"), "event_id"), "issue", "event_id")


@query("agg_scan_summary", "SELECT source, COUNT(DISTINCT lang) AS parents, COUNT(*) AS samples, CAST(SUM(n_chars) AS DOUBLE) / 3600 AS hours FROM documents GROUP BY source")
def agg_scan_summary(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("parents"), F.count("*").alias("samples"), (F.sum("n_chars") / 3600).alias("hours"))


@query("agg_distribution", "SELECT source, lang, COUNT(*) AS n FROM documents GROUP BY source, lang")
def agg_distribution(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("agg_talk_share", sql(SEGMENTS, "t AS (SELECT file_id, speaker, CAST(SUM(end_us - start_us) AS BIGINT) AS us FROM segments GROUP BY ALL)", select="SELECT file_id, speaker, us, us::DOUBLE / SUM(us) OVER (PARTITION BY file_id) AS share FROM t"))
def agg_talk_share(spark, d):
    return A.shares(segments(spark, d).withColumn("us", F.col("end_us") - F.col("start_us")), ["file_id", "speaker"], "us")


@query("agg_weighted_ratio", "SELECT l_shipmode, CAST(SUM(CAST(l_quantity AS BIGINT) * l_linenumber) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS mean, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_shipmode")
def agg_weighted_ratio(spark, d):
    rows = read(spark, d, "lineitem").withColumn("l_shipmode", F.concat("l_returnflag", "l_linestatus"))
    return A.weighted_mean(rows, ["l_shipmode"], F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"))


@query("agg_level_check", "SELECT level, CAST(SUM(p) AS BIGINT) AS part_us, CAST(SUM(w) AS BIGINT) AS whole_us, SUM(p) * 100.0::DOUBLE / SUM(w) AS percent, CASE WHEN level = 0 THEN SUM(p) = 0 ELSE abs(SUM(p) * 100.0::DOUBLE / SUM(w) - level) <= 3 END AS ok FROM (SELECT CAST(event_id % 4 * 10 AS BIGINT) AS level, CAST(event_id % 4 * 11 AS BIGINT) AS p, 100 AS w FROM events) GROUP BY level")
def agg_level_check(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select((e % 4 * 10).alias("level"), (e % 4 * 11).alias("part_us"), F.lit(100).cast("long").alias("whole_us"))
    return A.level_check(rows, "level", "part_us", "whole_us")


@query("agg_spread", "SELECT l_returnflag, COUNT(l_linenumber) AS n, MIN(l_linenumber) AS least, MAX(l_linenumber) AS most, quantile_cont(CAST(l_linenumber AS DOUBLE), 0.5) AS median, AVG(l_linenumber) AS mean, round(stddev_samp(l_linenumber), 6) AS stdev FROM lineitem GROUP BY l_returnflag")
def agg_spread(spark, d):
    return A.spread(read(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber").withColumn("stdev", F.round("stdev", 6))


@query("agg_run_counts", "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT (l_linestatus, l_suppkey)) AS cases, COUNT(DISTINCT l_discount) AS thresholds, COUNT(DISTINCT l_returnflag) AS checkpoints FROM lineitem")
def agg_run_counts(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n_rows"), F.countDistinct("l_linestatus", "l_suppkey").alias("cases"), F.countDistinct("l_discount").alias("thresholds"), F.countDistinct("l_returnflag").alias("checkpoints"))


@query("agg_checkpoint_report", """SELECT l_linestatus AS split, l_returnflag AS ckpt, l_linenumber AS n_spk, COUNT(*) AS cases, AVG(l_quantity) AS der, CAST(GROUPING_ID(l_linestatus, l_returnflag, l_linenumber) AS INTEGER) AS level FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linestatus, l_returnflag, l_linenumber))""")
def agg_checkpoint_report(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("ckpt"), F.col("l_linenumber").alias("n_spk"), F.col("l_quantity").alias("der"))
    return W.report(rows, [["split", "ckpt"], ["split", "ckpt", "n_spk"]], ["der"])


@query("agg_speaker_presence", "SELECT COUNT(DISTINCT role) AS speakers, COUNT(*) AS turns, MAX(turn) AS last_turn FROM conversations")
def agg_speaker_presence(spark, d):
    return read(spark, d, "conversations").agg(F.countDistinct("role").alias("speakers"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


@query("agg_top_speakers", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def agg_top_speakers(spark, d):
    return R.top(read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), [F.desc("n"), "user_id"], 10)


@query("agg_length_stats", "SELECT lang, AVG(n) AS avg_words, MAX(n) AS max_words FROM (SELECT lang, CAST(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS INTEGER) AS n FROM documents) GROUP BY lang")
def agg_length_stats(spark, d):
    n = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    return read(spark, d, "documents").groupBy("lang").agg(F.avg(n).alias("avg_words"), F.max(n).alias("max_words"))


@query("agg_flag_rates", "SELECT source, AVG(CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) AS generic, AVG(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) AS low FROM documents GROUP BY source")
def agg_flag_rates(spark, d):
    return A.flag_rates(read(spark, d, "documents"), ["source"], {"generic": F.contains(F.lower("text"), F.lit("license")), "low": F.col("n_chars") < 500})


@query("agg_missing_keys", "SELECT event_id, list_sort(list_filter(['k', 'summary', 'title'], lambda x: x <> 'k' AND NOT (x = 'title' AND event_id % 2 = 0))) AS missing FROM events")
def agg_missing_keys(spark, d):
    record = F.expr("if(event_id % 2 = 0, map('k', 1, 'title', 2), map('k', 1))")
    return read(spark, d, "events").withColumn("r", record).select("event_id", A.missing_keys("r", ["k", "summary", "title"]).alias("missing"))


@query("agg_file_groups", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS top_level, COUNT(*) AS files, COUNT(*) FILTER (WHERE length(html) > 2000) AS complete FROM pages GROUP BY ALL")
def agg_file_groups(spark, d):
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("top_level")).agg(F.count("*").alias("files"), F.count_if(F.char_length("html") > 2000).alias("complete"))


@query("agg_skip_counters", "SELECT COUNT(*) FILTER (WHERE n_chars < 300) AS skipped, COUNT(*) FILTER (WHERE n_chars >= 300) AS kept, COUNT(*) - COUNT(DISTINCT text) AS duplicates FROM documents")
def agg_skip_counters(spark, d):
    return read(spark, d, "documents").agg(F.count_if(F.col("n_chars") < 300).alias("skipped"), F.count_if(F.col("n_chars") >= 300).alias("kept"), (F.count("*") - F.countDistinct("text")).alias("duplicates"))


@query("agg_speakers_per_recording", sql(SEGMENTS, select="SELECT file_id, GREATEST(2, COUNT(DISTINCT speaker)) AS n_speakers, COUNT(*) AS n_segments FROM segments GROUP BY file_id"))
def agg_speakers_per_recording(spark, d):
    return segments(spark, d).groupBy("file_id").agg(F.greatest(F.lit(2).cast("long"), F.countDistinct("speaker")).alias("n_speakers"), F.count("*").alias("n_segments"))


PIVOT = ", ".join(f'CAST(SUM(CASE WHEN l_linenumber = {k} THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS "{k}"' for k in range(1, 8))


@query("agg_threshold_pivot", f"SELECT l_returnflag AS grp, {PIVOT} FROM lineitem GROUP BY l_returnflag")
def agg_threshold_pivot(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("thr"), F.col("l_quantity").cast("long").alias("q"))
    thresholds = sorted(r[0] for r in rows.select("thr").distinct().collect())
    return W.pivot_by_threshold(rows, "grp", "thr", "q", thresholds)


@query("win_adjacent_check", "SELECT o_orderkey, gap FROM (SELECT o_orderkey, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS gap FROM orders) WHERE gap > 500")
def win_adjacent_check(spark, d):
    from pyspark.sql import Window

    gap = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - F.col("o_orderkey")
    return read(spark, d, "orders").withColumn("gap", gap).where("gap > 500").select("o_orderkey", "gap")


@query("top_nearest_duration", "SELECT source, doc_id FROM (SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY abs(n_chars - 1000), doc_id) AS n FROM documents) WHERE n <= 3")
def top_nearest_duration(spark, d):
    return R.nearest(read(spark, d, "documents"), ["source"], F.abs(F.col("n_chars") - 1000), 3, "doc_id").select("source", "doc_id")


@query("set_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def set_union_all(spark, d):
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(read(spark, d, "customer").select(F.col("c_nationkey").alias("k")))


@query("set_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_intersect(spark, d):
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(read(spark, d, "customer").select("c_nationkey"))


@query("set_except", "SELECT p_size AS k FROM part EXCEPT SELECT s_nationkey FROM supplier")
def set_except(spark, d):
    return read(spark, d, "part").select(F.col("p_size").alias("k")).subtract(read(spark, d, "supplier").select("s_nationkey"))


@query("set_union_distinct", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def set_union_distinct(spark, d):
    o = read(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).union(o.where("o_orderpriority like '1%'").select("o_custkey")).distinct()
