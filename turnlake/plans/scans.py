"""Queries of scans, manifests, rates and the composed run. Files are tested on trees of their own; here the
same functions scan frames that the tables give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnlake.operators import aggregates as A
from turnlake.operators import dedup as D
from turnlake.operators import intervals as I
from turnlake.operators import joins as J
from turnlake.operators import metrics as M
from turnlake.operators import ranking as N
from turnlake.operators import sweep as W
from turnlake.operators.shared import shared_dir
from turnlake.functions import scalars as S
from turnlake.plans.joins import MATCHES, assigned
from turnlake.plans.metrics import BEST_SHARED, DER, DP
from turnlake.plans.intervals import WORDS
from turnlake.plans.views import DAY_US, HYP, HYP_LINES, LOCAL, SEGMENTS, TURNS, hyp, hyp_lines, islands_sql, local, read, ref, segments, sql, steps_sql
from turnlake.registry import query
from turnlake.sources import readers as R
from turnlake.sources import scans as C
from turnlake.sources import sinks as K
from turnlake.streaming.progress import run_progress


def split_of(spark, d) -> C.Split:
    """Conversations as recordings: audio a second longer than the text, metadata for two in three, turns
    moved by 700 ms, the questions of a conversation's numbers as its base units."""
    lines = ref(spark, d).select(F.concat(F.lit("data"), F.col("file_id").cast("string")).alias("file_id"), "start_us", "end_us", "speaker", "text")
    turns = hyp_lines(spark, d).select(F.concat(F.lit("data"), F.col("file_id").cast("string")).alias("file_id"), "start_us", "end_us", "speaker")
    ids = read(spark, d, "conversations").select("conv_id").distinct()
    name = F.concat(F.lit("data"), F.col("conv_id").cast("string"))
    ends = lines.groupBy("file_id").agg((F.max("end_us") + 1_000_000).alias("duration_us"))
    recordings = ids.select(name.alias("file_id"), F.concat(F.lit("/audio/"), name, F.lit(".wav")).alias("audio_path")).join(ends, "file_id")
    label = F.element_at(F.array(F.lit("VIF"), F.lit("Coi Mo"), F.lit("Talk-Show")), (F.col("conv_id") % 3 + 1).cast("int"))
    meta = ids.where("conv_id % 3 < 2").select(F.concat_ws(" | ", name, label, F.lit("a,b"), F.col("conv_id").cast("string")).alias("value"), F.lit(1).alias("line_no"))
    units = ids.select(name.alias("file_id"), F.concat(F.lit("u"), (F.col("conv_id") % 40).cast("string")).alias("unit"))
    return C.Split(recordings, lines, turns, R.class_table(meta), units)


REGIONS_LOCAL = [steps_sql("local"), "busy AS (SELECT file_id, start_us, end_us FROM steps WHERE active >= 2)", islands_sql("busy", "file_id", name="regions")]

PARENTS = """SELECT 'data' || CAST(file_id AS VARCHAR) AS file_id, md5(concat_ws('||', 'self_labeled', 'train', 'data' || CAST(file_id AS VARCHAR), '/audio/data' || CAST(file_id AS VARCHAR) || '.wav')) AS parent_id,
 CASE file_id % 3 WHEN 0 THEN 'vif' WHEN 1 THEN 'coi_mo' ELSE 'data' || CAST(file_id AS VARCHAR) END AS class_name, CASE file_id % 3 WHEN 0 THEN 'gold_real' WHEN 1 THEN 'hard_real' ELSE 'silver_real' END AS bucket,
 CASE WHEN file_id % 3 < 2 THEN CAST(file_id AS VARCHAR) ELSE '' END AS episode, MAX(end_us) + 1000000 AS duration_us FROM ref GROUP BY file_id"""


@query("scan_parents", sql(TURNS, select=PARENTS))
def scan_parents(spark, d):
    found = C.parents(split_of(spark, d), "train", "self_labeled")
    return found.select("file_id", "parent_id", "class_name", "bucket", "episode", "duration_us")


@query("scan_samples")
def scan_samples(spark, d):
    """Samples of the scan, limited by base units as the reused source's are."""
    return C.scan(split_of(spark, d), "train", C.REUSED_SOURCE, by_overlap=True)[1]


@query("scan_segments", sql(LOCAL, *REGIONS_LOCAL, "n AS (SELECT *, CAST(GREATEST(1, (end_us - start_us + 28999999) // 29000000) AS INTEGER) AS parts FROM local WHERE speaker <> '3'), p AS (SELECT *, unnest(range(0, parts)) AS part FROM n), q AS (SELECT file_id, seg_id, CAST(part AS INTEGER) AS part, start_us + (end_us - start_us) * part // parts AS a, start_us + (end_us - start_us) * (part + 1) // parts AS b FROM p), z AS (SELECT file_id, seg_id, part, GREATEST(0, a - 100000) AS start_us, LEAST(86400000000, b + 200000) AS end_us FROM q WHERE b - a >= 500000)", select="SELECT z.seg_id, z.part, ANY_VALUE(z.start_us) AS start_us, ANY_VALUE(z.end_us) AS end_us, CASE WHEN CAST(right(z.file_id, 2) AS INTEGER) % 2 = 0 THEN 'even_day' ELSE regexp_replace(z.file_id, '-', '_', 'g') END AS class_name, round(SUM(CASE WHEN r.start_us IS NULL THEN 0 ELSE LEAST(z.end_us, r.end_us) - GREATEST(z.start_us, r.start_us) END)::DOUBLE / GREATEST(ANY_VALUE(z.end_us - z.start_us), 1), 9) AS overlap_ratio FROM z LEFT JOIN regions r ON z.file_id = r.file_id AND z.start_us < r.end_us AND r.start_us < z.end_us GROUP BY z.seg_id, z.part, z.file_id"))
def scan_segments(spark, d):
    """Samples of the days' turns; speaker 3 stands for nobody, even days have a class."""
    turns = local(spark, d)
    days = turns.select("file_id").distinct()
    meta = days.where("cast(right(file_id, 2) as int) % 2 = 0").select(F.col("file_id").alias("name"), F.lit("Even Day").alias("class_name"))
    found = C.segment_samples(turns, days.withColumn("duration_us", F.lit(DAY_US)), meta, ("3",))
    return found.select("seg_id", "part", "start_us", "end_us", "class_name", F.round("overlap_ratio", 9).alias("overlap_ratio"))


@query("scan_partitions")
def scan_partitions(spark, d):
    """Parents, samples and hours of two scans of one tree under their partitions."""
    split = split_of(spark, d)
    parents, samples = C.scan_all({"self_train": (split, "train", "self_labeled", False), "vivos_train": (split, "train", "vivos", True)})
    counted = samples.groupBy("source_partition").agg(F.count("*").alias("samples"), F.round(F.sum("overlap_ratio"), 6).alias("overlap"))
    return parents.groupBy("source_partition").agg(F.count("*").alias("parents"), F.sum("duration_us").alias("duration_us")).join(counted, "source_partition")


PARTITIONS = ["self_train", "dubbed_train", "vivos_train", "robustness_train", "self_val"]
STAGE = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS parent_id, ['self_train', 'dubbed_train', 'vivos_train', 'robustness_train', 'self_val'][o_orderkey % 5 + 1] AS source_partition, o_custkey * 1000 AS duration_us FROM orders),
 s AS (SELECT md5(concat_ws('||', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR))) AS sample_id, p.parent_id, p.source_partition, CAST(l_discount * 3 AS DOUBLE) AS overlap_ratio, l_partkey AS unit FROM lineitem JOIN p ON CAST(l_orderkey AS VARCHAR) = p.parent_id),
 b AS (SELECT * FROM p WHERE source_partition IN ({base})), t AS (SELECT SUM(duration_us) * {ratio}::DOUBLE AS target FROM b),
 v AS (SELECT *, COALESCE(SUM(duration_us) OVER (ORDER BY md5(concat_ws('|', parent_id, '{seed}')), parent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE source_partition = 'vivos_train'),
 ch AS (SELECT parent_id FROM b UNION ALL SELECT parent_id FROM v, t WHERE before < target),
 m AS (SELECT DISTINCT 'train' AS part, sample_id, parent_id, source_partition, overlap_ratio, unit FROM s WHERE parent_id IN (SELECT parent_id FROM ch) AND source_partition <> 'self_val' AND overlap_ratio <= {allowed}::DOUBLE UNION ALL SELECT DISTINCT 'val', sample_id, parent_id, source_partition, overlap_ratio, unit FROM s WHERE source_partition = 'self_val' AND overlap_ratio <= GREATEST(0.35, {allowed})::DOUBLE),
 r AS (SELECT *, CASE WHEN part = 'train' AND source_partition = 'vivos_train' THEN ROW_NUMBER() OVER (PARTITION BY part, source_partition, unit ORDER BY sample_id) ELSE 0 END AS n FROM m)"""


def manifest_frames(spark, d):
    parents = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("parent_id"), F.element_at(F.array(*map(F.lit, PARTITIONS)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("source_partition"), (F.col("o_custkey") * 1000).alias("duration_us"))
    keys = [*(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.round(F.col("l_discount") * 100).cast("long").cast("string")]
    samples = read(spark, d, "lineitem").select(F.md5(F.concat_ws("||", *keys)).alias("sample_id"), F.col("l_orderkey").cast("string").alias("parent_id"), (F.col("l_discount") * 3).cast("double").alias("overlap_ratio"), F.col("l_partkey").alias("unit"))
    return parents, samples.join(parents.select("parent_id", "source_partition"), "parent_id")


@query("pipe_stage_one", sql(STAGE.format(base="'self_train', 'dubbed_train'", ratio=0.1, seed=42 + 13, allowed=0.18), select="SELECT part, sample_id, source_partition FROM r WHERE n <= 2"))
def pipe_stage_one(spark, d):
    parents, samples = manifest_frames(spark, d)
    return C.stage_manifest(parents, samples, 0.18, 0.1, 42, unit="unit").select("part", "sample_id", "source_partition")


@query("pipe_stage_two", sql(STAGE.format(base="'self_train', 'dubbed_train', 'robustness_train'", ratio=0.05, seed=142 + 13, allowed=0.3), select="SELECT part, sample_id, source_partition FROM r WHERE n <= 2"))
def pipe_stage_two(spark, d):
    parents, samples = manifest_frames(spark, d)
    return C.stage_manifest(parents, samples, 0.3, 0.05, 142, second=True, unit="unit").select("part", "sample_id", "source_partition")


@query("sink_stage_manifests", sql(STAGE.format(base="'self_train', 'dubbed_train'", ratio=0.1, seed=42 + 13, allowed=0.18), select="SELECT 'stage1' AS stage, part AS split, source_partition, COUNT(*) AS n, COUNT(DISTINCT parent_id) AS parents, MIN(sample_id) AS first, MAX(sample_id) AS last, CAST(SUM(CAST('0x' || substr(sample_id, 1, 8) AS BIGINT)) AS BIGINT) AS ids, CAST(SUM(unit) AS BIGINT) AS units, round(SUM(overlap_ratio), 6) AS overlap FROM r WHERE n <= 2 GROUP BY part, source_partition"))
def sink_stage_manifests(spark, d):
    """A stage's manifests and the scan's summary written as files, and what is read back of them."""
    parents, samples = manifest_frames(spark, d)
    path = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    C.export_manifests(path, parents, samples, {"stage1": C.stage_manifest(parents, samples, 0.18, 0.1, 42, unit="unit")})
    back = C.read_jsonl(spark, f"{path}/stages", "sample_id string, parent_id string, source_partition string, overlap_ratio double, unit long, stage string, split string")
    ids = F.conv(F.substring("sample_id", 1, 8), 16, 10).cast("long")
    aggs = [F.count("*").alias("n"), F.countDistinct("parent_id").alias("parents"), F.min("sample_id").alias("first"), F.max("sample_id").alias("last"), F.sum(ids).alias("ids"), F.sum("unit").alias("units"), F.round(F.sum("overlap_ratio"), 6).alias("overlap")]
    return back.groupBy("stage", "split", "source_partition").agg(*aggs)


@query("sink_scan_report", sql(STAGE.format(base="'self_train'", ratio=0.1, seed=1, allowed=1), select="SELECT p.source_partition, parents, hours, COALESCE(samples, 0) AS samples FROM (SELECT source_partition, COUNT(*) AS parents, round(SUM(duration_us) / 3.6e9::DOUBLE, 3) AS hours FROM p GROUP BY ALL) p LEFT JOIN (SELECT source_partition, COUNT(*) AS samples FROM s GROUP BY ALL) c ON p.source_partition = c.source_partition"))
def sink_scan_report(spark, d):
    """The scan's summary as CSV, read back."""
    parents, samples = manifest_frames(spark, d)
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    K.write_csv(C.scan_summary(parents, samples), path)
    return spark.read.option("header", True).schema("source_partition string, parents long, hours double, samples long").csv(path)


@query("scan_sessions", "SELECT 'data' || CAST(p_partkey AS VARCHAR) AS file_id, CASE WHEN ov = 0 THEN 'tier_A_0pct' WHEN ov BETWEEN 5 AND 10 THEN 'tier_B_5_10pct' WHEN ov = 15 THEN 'tier_C_15pct' ELSE 'tier_D_20_30pct' END AS source, n AS n_speakers, LEAST(n, 4) AS load_speakers, CASE WHEN n <= 4 THEN 'spk' || CAST(n AS VARCHAR) ELSE 'spk5plus' END AS folder FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS ov, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 + 1 ELSE p_partkey % 7 END AS INTEGER) AS n FROM part WHERE p_partkey % 4 <> 0)")
def scan_sessions(spark, d):
    """Parts as sessions: every fourth lacks segments, every third metadata, so that its turns count."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("data"), k.cast("string"))
    recordings = p.select(name.alias("file_id"), F.lit("mixture.wav").alias("wav_path"), F.when(k % 4 != 0, F.lit("mixture.rttm")).alias("rttm_path"), F.lit(60_000_000).cast("long").alias("duration_us"), F.lit(None).cast("string").alias("enrollment_dir"))
    turns = p.select(name.alias("file_id"), F.explode(F.sequence(F.lit(0).cast("long"), k % 2)).alias("speaker"))
    lines = p.where("p_partkey % 3 <> 0").select(F.concat_ws(" | ", name, F.col("p_size").cast("string"), (k % 7).cast("string"), F.lit("1")).alias("value"))
    return C.sessions(recordings, turns, R.overlap_table(lines), "tier").select("file_id", "source", "n_speakers", "load_speakers", "folder")


@query("src_case_discovery", "SELECT case_id, COALESCE(NULLIF(m, 0), NULLIF(e, 0), NULLIF(t, 0), 3) AS n_speakers, CASE WHEN k % 5 < 3 THEN 'c' || CAST(k % 2 AS VARCHAR) ELSE 'unknown' END AS group_name, audio FROM (SELECT p_partkey AS k, 'data' || CAST(p_partkey AS VARCHAR) AS case_id, CAST(CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 4 END AS INTEGER) AS m, CAST(p_partkey % 3 AS INTEGER) AS e, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS t, CASE WHEN p_partkey % 6 = 0 THEN 'audio.flac' ELSE 'mixture.wav' END AS audio FROM part WHERE p_partkey % 7 <> 0)")
def src_case_discovery(spark, d):
    """Cases from a listing, metadata lines and turns; every seventh folder lacks its segments."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("data"), k.cast("string")).alias("folder")
    enrolled = (k % 3).cast("int").alias("enrolled")
    audio = p.select(name, F.when(k % 6 == 0, F.lit("audio.flac")).otherwise(F.lit("mixture.wav")).alias("file"), enrolled)
    listing = audio.unionByName(p.where("p_partkey % 7 <> 0").select(name, F.lit("mixture.rttm").alias("file"), enrolled))
    turns = p.where("p_partkey % 2 = 0").select(name.alias("file_id"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("speaker"))
    lines = p.where("p_partkey % 5 < 3").select(F.to_json(F.struct(name.alias("id"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("scene"), (k % 4).cast("string").alias("spk"))).alias("value"))
    records = R.case_of(R.record_maps(lines), p.select(name.alias("case_id")), ["case_id", "id"])
    return C.cases(listing, records, turns, "test_labeled").select("case_id", "n_speakers", "group_name", "audio")


@query("scan_runs", "SELECT run, CAST(MAX(ts) AS TIMESTAMP) AS updated, bool_or(rel LIKE 'der/%') AS has_der, bool_or(rel = 'asr/asr_results.csv') AS has_asr, bool_or(rel = 'qwen/qwen_summary.md') AS has_summary, COUNT(*) AS file_count, CASE WHEN bool_or(rel LIKE 'der/%') AND bool_or(rel = 'asr/asr_results.csv') THEN 'complete' ELSE 'partial' END AS status FROM (SELECT 'run' || CAST(user_id AS VARCHAR) AS run, ['der/a.rttm', 'asr/asr_results.csv', 'qwen/qwen_summary.md', 'log/x.txt'][event_id % 4 + 1] AS rel, ts FROM events) GROUP BY run")
def scan_runs(spark, d):
    files = read(spark, d, "events").select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"), F.element_at(F.array(*map(F.lit, ("der/a.rttm", "asr/asr_results.csv", "qwen/qwen_summary.md", "log/x.txt"))), (F.col("event_id") % 4 + 1).cast("int")).alias("rel"), F.col("ts").cast("timestamp_ntz").alias("modified"))
    return C.run_list(files)


@query("src_segment_manifest", sql(TURNS, select="SELECT CAST(file_id AS VARCHAR) || '_' || CAST(seg_id AS VARCHAR) AS sample_id, CASE WHEN seg_id % 3 = 0 THEN 0 ELSE start_us END AS start_us, end_us, GREATEST(0, end_us - CASE WHEN seg_id % 3 = 0 THEN 0 ELSE start_us END) AS duration_us, CASE WHEN seg_id % 2 = 0 THEN speaker ELSE 'Unknown' END AS speaker, text FROM ref"))
def src_segment_manifest(spark, d):
    start, end = K.decimal_seconds(F.col("start_us")), K.decimal_seconds(F.col("end_us"))
    record = F.to_json(F.struct(F.when(F.col("seg_id") % 3 != 0, start).alias("start"), end.alias("end"), F.when(F.col("seg_id") % 2 == 0, F.col("speaker")).alias("speaker"), "text"))
    lines = ref(spark, d).select(F.col("file_id").cast("string").alias("file_id"), F.col("seg_id").alias("line_no"), record.alias("value"))
    return C.segment_manifest(lines, "/root").select("sample_id", "start_us", "end_us", "duration_us", "speaker", "text")


@query("src_normal_reference", sql(TURNS, select="SELECT file_id, seg_id, t AS text FROM (SELECT file_id, seg_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{Nd}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM ref) WHERE t <> ''"))
def src_normal_reference(spark, d):
    return C.normal_reference(ref(spark, d)).select("file_id", "seg_id", "text")


@query("sc_normal_record", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS class_name, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(event_id % 30 AS DOUBLE) END AS overlap, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS INTEGER) AS n_speakers FROM events")
def sc_normal_record(spark, d):
    e = F.col("event_id")
    record = F.when(e % 3 == 0, F.create_map(F.lit("scene"), F.lit("a"), F.lit("ovl"), F.concat((e % 30).cast("string"), F.lit("%")), F.lit("spk"), (e % 5).cast("string"))).when(e % 3 == 1, F.create_map(F.lit("class"), F.lit("b"), F.lit("overlap"), (e % 30).cast("string"), F.lit("spk"), F.lit("none"))).otherwise(F.create_map(F.lit("note"), F.lit("x")))
    return read(spark, d, "events").withColumn("r", record).select("event_id", *C.normal_record("r"))


EVIDENCE = """i AS (SELECT file_id, seg_id AS item_id, CASE WHEN seg_id % 9 = 0 THEN 'nobody' ELSE speaker END AS speaker, CASE seg_id % 4 WHEN 0 THEN [] WHEN 1 THEN [[start_us + 7000000]] WHEN 2 THEN [[start_us + 9000000, start_us + 7000000], [start_us + 7000000, start_us + 9000000]] ELSE [[start_us - 3000000, start_us - 1000000], [start_us + 400000000, start_us + 1]] END AS spans FROM segments),
 x AS (SELECT file_id, item_id, speaker, unnest(spans) AS s, unnest(range(1, len(spans) + 1)) AS pos FROM i), e AS (SELECT * FROM x WHERE len(s) = 2),
 f AS (SELECT item_id, MIN(pos) AS met FROM e WHERE EXISTS (SELECT 1 FROM segments l WHERE l.file_id = e.file_id AND l.speaker = e.speaker AND NOT (e.s[2] < l.start_us OR l.end_us < e.s[1])) GROUP BY item_id),
 v AS (SELECT DISTINCT e.item_id FROM e LEFT JOIN f ON e.item_id = f.item_id WHERE s[2] >= s[1] AND (met IS NULL OR pos <= met))"""


@query("met_evidence_rates", sql(SEGMENTS, EVIDENCE, select="SELECT i.file_id, COUNT(*) AS n_items, AVG(CASE WHEN v.item_id IS NULL THEN 0.0 ELSE 1.0 END) AS valid_rate, AVG(CASE WHEN f.met IS NULL THEN 0.0 ELSE 1.0 END) AS support_rate, AVG(CASE WHEN EXISTS (SELECT 1 FROM segments l WHERE l.file_id = i.file_id AND l.speaker = i.speaker) THEN 1.0 ELSE 0.0 END) AS presence_rate FROM i LEFT JOIN v ON i.item_id = v.item_id LEFT JOIN f ON i.item_id = f.item_id GROUP BY i.file_id"))
def met_evidence_rates(spark, d):
    """Items of every segment: none, a broken, a reversed and a straight span, or spans that miss it."""
    s = segments(spark, d)
    spans = F.expr(
        "case seg_id % 4 when 0 then cast(array() as array<array<bigint>>) when 1 then array(array(start_us + 7000000)) when 2 then array(array(start_us + 9000000, start_us + 7000000), array(start_us + 7000000, start_us + 9000000))"
        " else array(array(start_us - 3000000, start_us - 1000000), array(start_us + 400000000, start_us + 1)) end"
    )
    items = s.select("file_id", F.col("seg_id").alias("item_id"), F.when(F.col("seg_id") % 9 == 0, F.lit("nobody")).otherwise(F.col("speaker")).alias("speaker"), spans.alias("spans"))
    return A.evidence_rates(items, s)


@query("agg_schema_rates", "SELECT event_id, list_sort(list_filter(['action_items', 'segments', 'meeting_type'], lambda x: x <> 'segments' AND NOT (x = 'meeting_type' AND event_id % 2 = 0))) AS missing, false AS whole, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END / 3.0::DOUBLE AS pass_rate FROM events")
def agg_schema_rates(spark, d):
    record = F.expr("if(event_id % 2 = 0, map('segments', 1, 'meeting_type', 2), map('segments', 1))")
    return read(spark, d, "events").withColumn("r", record).select("event_id", *A.schema_rates("r", ["action_items", "segments", "meeting_type"]))


@query("met_der_rates", sql(HYP, *DER, """t AS (SELECT file_id, SUM(d * nr)::DOUBLE AS ref_us, SUM(d * GREATEST(0, nr - nh))::DOUBLE AS miss_us, SUM(d * GREATEST(0, nh - nr))::DOUBLE AS fa_us, SUM(d * (LEAST(nr, nh) - nc))::DOUBLE AS conf_us,
 SUM(CASE WHEN nr >= 2 AND nh >= 2 THEN d ELSE 0 END)::DOUBLE AS b, SUM(CASE WHEN nh >= 2 THEN d ELSE 0 END)::DOUBLE AS h, SUM(CASE WHEN nr >= 2 THEN d ELSE 0 END)::DOUBLE AS r FROM c GROUP BY file_id)""", select="SELECT file_id, CASE WHEN ref_us > 0 THEN (miss_us + fa_us + conf_us) / ref_us ELSE 0 END AS der, CASE WHEN h > 0 THEN b / h ELSE 0 END AS ov_precision, CASE WHEN r > 0 THEN b / r ELSE 0 END AS ov_recall, CASE WHEN h + r > 0 THEN 2 * b / (h + r) ELSE 0 END AS ov_f1 FROM t"))
def met_der_rates(spark, d):
    return M.der_rates(M.der(segments(spark, d), hyp(spark, d))).select("file_id", "der", "ov_precision", "ov_recall", "ov_f1")


FAIR = "f AS (SELECT seg_id, COALESCE(SUM(end_us - start_us) OVER (PARTITION BY file_id, speaker ORDER BY start_us, end_us, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own, COALESCE(SUM(end_us - start_us) OVER (PARTITION BY file_id ORDER BY start_us, end_us, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS every FROM segments)"


@query("win_fairness", sql(SEGMENTS, FAIR, select="SELECT seg_id, round(1.0 - own::DOUBLE / GREATEST(every, 1)::DOUBLE + 0.1::DOUBLE, 9) AS weight FROM f"))
def win_fairness(spark, d):
    return A.fairness_weights(segments(spark, d)).select("seg_id", F.round("weight", 9).alias("weight"))


@query("win_fairness_sliced", sql(SEGMENTS, FAIR, select="SELECT seg_id, round(1.0 - own::DOUBLE / GREATEST(every, 1)::DOUBLE + 0.1::DOUBLE, 9) AS weight FROM f"))
def win_fairness_sliced(spark, d):
    return A.fairness_weights(segments(spark, d), slice_us=3_600_000_000).select("seg_id", F.round("weight", 9).alias("weight"))


@query("top_composite_order", sql(SEGMENTS, select="SELECT file_id, list(seg_id ORDER BY speaker, start_us DESC, seg_id) AS ids FROM segments GROUP BY file_id"))
def top_composite_order(spark, d):
    """Segments of a recording by speaker, latest first: the order itself is the result."""
    row = F.struct("speaker", (-F.col("start_us")).alias("late"), "seg_id")
    return segments(spark, d).groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["seg_id"]).alias("ids"))


CTC = """t AS (SELECT conv_id AS file_id, turn AS seg_id, list_transform(range(0, length(text)), lambda i: CASE WHEN i % 5 = 4 THEN '<pad>' WHEN i % 7 = 3 THEN '##' || text[i + 1] ELSE text[i + 1] END) AS tokens, list_filter(regexp_split_to_array(text, ' '), lambda x: x <> '') AS words FROM conversations),
 a AS (SELECT *, list_filter(list_zip(tokens, range(0, len(tokens))), lambda x: x[1] <> '<pad>') AS told FROM t), k AS (SELECT *, list_filter(told, lambda x, i: i = 1 OR x[1] <> told[i - 1][1]) AS kept FROM a),
 f AS (SELECT *, list_transform(list_filter(kept, lambda x, i: i = 1 OR NOT starts_with(x[1], '##')), lambda x: x[2]) AS fr FROM k)"""


@query("met_token_word_times", sql(CTC, select="SELECT file_id, seg_id, CASE WHEN len(fr) = 0 OR len(words) = 0 THEN [] ELSE list_transform(words, lambda w, i: CAST(floor(fr[LEAST(CAST(floor((i - 1) * (len(fr)::DOUBLE / len(words))) AS BIGINT), len(fr) - 1) + 1] * (len(tokens) * 20000)::DOUBLE / len(tokens) + 0.5) AS BIGINT)) END AS starts FROM f"))
def met_token_word_times(spark, d):
    """Letters of turns as a recogniser's tokens, 20 ms a frame; every fifth blank, every seventh joined."""
    letters = F.expr("transform(filter(split(text, ''), x -> x <> ''), (x, i) -> case when i % 5 = 4 then '<pad>' when i % 7 = 3 then concat('##', x) else x end)")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_id"), letters.alias("tokens"), F.expr("filter(split(text, ' '), x -> x <> '')").alias("words"))
    timed = M.token_word_times(c.withColumn("duration_us", F.size("tokens") * F.lit(20_000).cast("long")))
    return timed.select("file_id", "seg_id", F.transform("times", lambda x: x["start_us"]).alias("starts"))


@query("join_case_noise", "SELECT c_custkey AS case_id, c_custkey % 30 AS noise, c_mktsegment AS group_name FROM customer WHERE c_custkey % 10 = 3")
def join_case_noise(spark, d):
    """Chosen cases with their noise; one without a sample would fail the query."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("group_name"))
    chosen = c.where("case_id % 10 = 3").select("case_id", (F.col("case_id") % 30).alias("noise"))
    return J.case_noise(chosen, c)


@query("pipe_attempts", "SELECT n_nationkey AS task, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'done ' || CAST(n_nationkey AS VARCHAR) END AS result, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError: bad task' END AS error, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS tries FROM nation")
def pipe_attempts(spark, d):
    """Two passes over a grid of tasks; every fifth fails in both."""

    def task(row: dict) -> str:
        if row["task"] % 5 == 0:
            raise ValueError("bad task")
        return f"done {row['task']}"

    return W.attempt(read(spark, d, "nation").select(F.col("n_nationkey").alias("task")), task)


@query("pipe_attempt_ledger", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE 'done ' || CAST(l_orderkey AS VARCHAR) END AS result, CASE WHEN l_partkey % 50 = 0 THEN 'ValueError: bad task' END AS error, CAST(CASE WHEN l_partkey % 50 = 0 THEN 2 ELSE 1 END AS INTEGER) AS tries FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def pipe_attempt_ledger(spark, d):
    """Two passes over line items with a table of results as the ledger; the parts of every fiftieth number fail."""

    def task(row: dict) -> str:
        if row["l_partkey"] % 50 == 0:
            raise ValueError("bad task")
        return f"done {row['l_orderkey']}"

    grid = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return W.run_passes(grid, grid.columns, task, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


PROGRESS = """e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type AS stage, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS done FROM events), m AS (SELECT session, stage, MIN(us) AS start, MAX(done) AS done, MAX(us) // 1000 + 600000 < (SELECT MAX(us) // 1000 - 600000 FROM e) AS silent FROM e GROUP BY ALL),
 a AS (SELECT m.session, m.stage, m.done, MIN(us) - ANY_VALUE(start) AS elapsed, ANY_VALUE(silent) AS silent FROM m JOIN e ON m.session = e.session AND m.stage = e.stage AND m.done = e.done GROUP BY m.session, m.stage, m.done)"""


@query("pipe_progress", sql(PROGRESS, select="SELECT session, stage, done, CAST(500 AS BIGINT) AS total, elapsed AS elapsed_us, CASE WHEN done > 0 THEN elapsed * (500 - done) // done END AS left_us, silent AS timed_out FROM a"))
def pipe_progress(spark, d):
    """Events as a stream of progress lines: users are sessions, kinds of events are stages. At the stream's end
    those silent for ten minutes before the watermark (ten minutes behind the last event) have timed out."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    value = F.concat(F.lit("PROGRESS:"), F.floor("value").cast("string"), F.lit("/500"))
    lines = events.select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"))
    return run_progress(lines, f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}")


RUN = [
    HYP_LINES,
    MATCHES,
    "segments AS (SELECT file_id, speaker, start_us, end_us FROM ref), hyp AS (SELECT file_id, speaker, start_us, end_us FROM hypl), hm AS (SELECT file_id, 'voice ' || speaker AS speaker, start_us, end_us FROM hypl)",
    *DER,
    *BEST_SHARED,
    "t AS (SELECT c.file_id, CAST(SUM(d * nr) AS BIGINT) AS ref_us, CAST(SUM(d * GREATEST(nr, nh)) - COALESCE(ANY_VALUE(best), 0) AS BIGINT) AS wrong_us FROM c LEFT JOIN bt ON c.file_id = bt.file_id GROUP BY c.file_id)",
    f"e AS (SELECT file_id, CAST(SUM({DP.format(a='ref_words', b='words')}) AS BIGINT) AS edits, CAST(SUM(len(ref_words)) AS BIGINT) AS n_words FROM assigned GROUP BY file_id)",
    "z AS (SELECT h.file_id, AVG(CASE WHEN EXISTS (SELECT 1 FROM ref l WHERE l.file_id = h.file_id AND l.speaker = h.speaker AND NOT (h.end_us < l.start_us OR l.end_us < h.start_us)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS evidence, AVG(CASE WHEN len(words) < 8 THEN 1.0 ELSE 0.0 END)::DOUBLE AS generic, AVG(len(words))::DOUBLE AS words FROM hypl h GROUP BY h.file_id)",
]
SUMMARY = f"{S.SCORE_WEIGHTS['schema']}::DOUBLE + {S.SCORE_WEIGHTS['evidence']}::DOUBLE * evidence + {S.SCORE_WEIGHTS['specific']}::DOUBLE * (1 - generic) + {S.SCORE_WEIGHTS['compact']}::DOUBLE * CASE WHEN words <= {S.LONG_WORDS} THEN 1 ELSE GREATEST(0, 1 - (words - {S.LONG_WORDS}) / {S.LONG_SPAN}) END"


@query("pipe_full_run", sql(*RUN, select=f"SELECT t.file_id, ref_us, wrong_us, edits, n_words, wrong_us::DOUBLE / ref_us AS der, edits::DOUBLE / GREATEST(n_words, 1) AS wer, round({SUMMARY}, 6) AS summary FROM t JOIN e ON t.file_id = e.file_id JOIN z ON t.file_id = z.file_id"))
def pipe_full_run(spark, d):
    """A whole run over recordings: diarization error under the best mapping of the hypothesis' voices, recognition
    error on the reference that is assigned to the hypothesis, and the score of a summary that quotes every
    hypothesis line at its time (short lines are generic), per recording."""
    said, heard = ref(spark, d), hyp_lines(spark, d)
    voices = heard.select("file_id", F.concat(F.lit("voice "), "speaker").alias("speaker"), "start_us", "end_us")
    times = M.der_mapped(said.select("file_id", "speaker", "start_us", "end_us"), voices)
    wrong = times.select("file_id", "ref_us", (F.col("miss_us") + F.col("fa_us") + F.col("conf_us")).alias("wrong_us"))
    scored = assigned(spark, d).select("file_id", M.edit_distance("ref_words", "words").alias("e"), F.size("ref_words").alias("n"))
    words = scored.groupBy("file_id").agg(F.sum("e").alias("edits"), F.sum("n").alias("n_words"))
    items = heard.select("file_id", F.col("hyp_id").alias("item_id"), "speaker", F.array(F.array("start_us", "end_us")).alias("spans"))
    evidence = A.evidence_rates(items, said.select("file_id", "speaker", "start_us", "end_us")).select("file_id", "support_rate")
    texts = heard.groupBy("file_id").agg(F.avg((F.size("words") < 8).cast("double")).alias("generic"), F.avg(F.size("words")).alias("average"))
    summary = evidence.join(texts, "file_id").select("file_id", F.round(S.quality_score(F.lit(1.0), F.col("support_rate"), F.col("generic"), F.col("average")), 6).alias("summary"))
    both = wrong.join(words, "file_id").join(summary, "file_id")
    rates = both.withColumn("der", F.col("wrong_us") / F.col("ref_us")).withColumn("wer", F.col("edits") / F.greatest(F.col("n_words"), F.lit(1)))
    return rates.select("file_id", "ref_us", "wrong_us", "edits", "n_words", "der", "wer", "summary")


@query("src_prediction_counters", "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE event_id % 11 = 0) AS no_text, COUNT(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 7 = 0) AS bad_times, COUNT(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 7 <> 0) AS kept FROM events")
def src_prediction_counters(spark, d):
    e = F.col("event_id")
    start = F.when(e % 7 == 0, F.lit("oops")).otherwise(e.cast("string"))
    rows = read(spark, d, "events").select(start.alias("start"), F.concat(e.cast("string"), F.lit(".5")).alias("end"), F.when(e % 11 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("predicted_text"))
    return R.prediction_counters(rows)


@query("src_prompt_texts", "SELECT 'u' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'word ' || CAST(p_size AS VARCHAR) END AS text FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def src_prompt_texts(spark, d):
    """Alignments of even parts, prompts of every third: the prompt counts."""
    p = read(spark, d, "part")
    name = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    words = F.transform(F.array(F.lit("word"), F.col("p_size").cast("string")), lambda w: F.struct(w.alias("word")))
    aligned = p.where("p_partkey % 2 = 0").select(name.alias("audio_id"), words.alias("words"))
    return R.prompt_texts(aligned, p.where("p_partkey % 3 = 0").select(F.concat(name, F.lit("\t"), "p_brand").alias("value")))


STAMP = "printf('%d.%03d', ({us} + 500) // 1000000, ({us} + 500) // 1000 % 1000)"


@query("sink_prompt_transcript", sql(TURNS, select=f"SELECT file_id, STRING_AGG('[' || {STAMP.format(us='start_us')} || '-' || {STAMP.format(us='end_us')} || '] ' || speaker || ': ' || text, chr(10) ORDER BY start_us, end_us) AS transcript FROM ref GROUP BY file_id"))
def sink_prompt_transcript(spark, d):
    return K.prompt_transcript(ref(spark, d), "file_id")


CHANGES = [
    WORDS,
    "moved AS (SELECT file_id, seg_id, start_us - CASE WHEN seg_id % 2 = 1 THEN 900000 ELSE 0 END AS start_us, end_us FROM ref)",
    steps_sql("moved"),
    "cut AS (SELECT file_id, start_us AS t0, end_us AS t1 FROM steps WHERE active > 0 AND end_us - start_us >= 10000), x AS (SELECT p.file_id, t0, t1, speaker, STRING_AGG(word, ' ' ORDER BY word_start_us, seg_id, pos, word) AS text FROM pw p JOIN cut c ON p.file_id = c.file_id AND (word_start_us + word_end_us) // 2 >= t0 AND (word_start_us + word_end_us) // 2 < t1 GROUP BY p.file_id, t0, t1, speaker)",
]


@query("sink_stm_change_points", sql(TURNS, *CHANGES, select=f"SELECT CAST(file_id AS VARCHAR) || ' 1 ' || speaker || ' ' || {STAMP.format(us='t0')} || ' ' || {STAMP.format(us='t1')} || ' <o,f0,unk> ' || text AS value FROM x"))
def sink_stm_change_points(spark, d):
    r = ref(spark, d)
    moved = r.select("file_id", "seg_id", (F.col("start_us") - F.when(F.col("seg_id") % 2 == 1, 900_000).otherwise(0)).alias("start_us"), "end_us")
    words = I.project_words(r).select("file_id", "seg_id", "speaker", "pos", "word", "word_start_us", "word_end_us")
    return K.change_point_stm(words, moved).select("value")


@query("top_nearest_pick", "SELECT source, doc_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS k FROM (SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY abs(n_chars - 1000), doc_id) AS n FROM documents) WHERE n <= 3) WHERE k = 1")
def top_nearest_pick(spark, d):
    """One of the three documents of a source that are nearest to a length."""
    near = N.nearest(read(spark, d, "documents"), ["source"], F.abs(F.col("n_chars") - 1000), 3, "doc_id")
    return N.pick(near, ["source"], "doc_id").select("source", "doc_id")


@query("dd_overlap_representatives", "SELECT 'vivo_ov' || CAST(p_size AS VARCHAR) AS label, MIN(p_partkey) AS p_partkey FROM part WHERE p_size IN (5, 10) GROUP BY p_size")
def dd_overlap_representatives(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("overlap"))
    return D.overlap_representatives(p, "overlap", [0.0, 5.0, 10.0], ["p_partkey"], "vivo_ov").select("label", "p_partkey")


@query("met_mix_at_snr", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS n FROM embeddings), g AS (SELECT *, sqrt(list_sum(list_transform(s, lambda x: x * x)) / (list_sum(list_transform(n, lambda x: x * x)) * pow(10.0::DOUBLE, (vec_id % 20)::DOUBLE / 10))) AS gain FROM e) SELECT vec_id, round(list_sum(list_transform(range(1, len(s) + 1), lambda i: abs(s[i] + gain * n[i]))), 6) AS loudness FROM g")
def met_mix_at_snr(spark, d):
    e = read(spark, d, "embeddings").withColumn("noise", F.reverse("embedding"))
    mixed = e.select("vec_id", M.mix_at_snr("embedding", "noise", (F.col("vec_id") % 20).cast("double")).alias("mix"))
    return mixed.select("vec_id", F.round(F.aggregate("mix", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("loudness"))
