"""Queries of string and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import scalars as S
from turnlake.functions import text as X
from turnlake.operators import metrics as M
from turnlake.plans.views import read
from turnlake.registry import query


def docs(spark, d):
    return read(spark, d, "documents")


@query("str_normalize_spoken", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents")
def str_normalize_spoken(spark, d):
    return docs(spark, d).select("doc_id", X.normalize_spoken(F.col("text")).alias("t"))


@query("str_clean_text", "SELECT doc_id, turn, t FROM (SELECT conv_id AS doc_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def str_clean_text(spark, d):
    return read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", X.clean_text(F.col("text")).alias("t"))


@query("str_names", """SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '[^0-9a-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, regexp_replace(regexp_replace(trim(c_mktsegment), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
 trim(regexp_replace(translate(lower(c_name), '-_', '  '), '\\s+', ' ', 'g')) AS grp, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_. ]+|[_. ]+$', '', 'g') AS folder FROM customer""")
def str_names(spark, d):
    return read(spark, d, "customer").select("c_custkey", X.normalize_name(F.col("c_name")).alias("name"), X.slug(F.col("c_mktsegment")).alias("slug"), X.normalize_group(F.col("c_name")).alias("grp"), X.folder_name(F.col("c_name")).alias("folder"))


@query("str_stable_id", "SELECT o_orderkey, md5(concat_ws('||', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS id FROM orders")
def str_stable_id(spark, d):
    return read(spark, d, "orders").select("o_orderkey", X.stable_id(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


@query("str_speaker_of", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'speaker_unknown' ELSE split_part(event_type || '_' || CAST(user_id AS VARCHAR), '_', -1) END AS speaker FROM events")
def str_speaker_of(spark, d):
    name = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")))
    return read(spark, d, "events").select("event_id", X.speaker_of(name).alias("speaker"))


@query("str_first_number", "SELECT p_partkey, TRY_CAST(NULLIF(regexp_extract(p_name || ' ' || p_brand, '-?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE) AS n FROM part")
def str_first_number(spark, d):
    return read(spark, d, "part").withColumn("t", F.concat("p_name", F.lit(" "), "p_brand")).select("p_partkey", X.number_in("t").alias("n"))


@query("str_overlap_bucket", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 7 = 0 THEN 'unknown' WHEN floor(l_quantity / 4) = l_quantity / 4 THEN 'ov' || CAST(CAST(floor(l_quantity / 4) AS BIGINT) AS VARCHAR) ELSE 'ov' || CAST(l_quantity / 4 AS VARCHAR) END AS bucket FROM lineitem")
def str_overlap_bucket(spark, d):
    value = F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity") / 4)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.overlap_bucket(value).alias("bucket"))


@query("str_sample_label", "SELECT o_orderkey, concat_ws(' | ', o_orderstatus, o_orderpriority, CAST(o_orderkey AS VARCHAR)) AS label FROM orders")
def str_sample_label(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.concat_ws(" | ", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("label"))


@query("str_time_formats", """SELECT event_id, printf('%d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) AS clock, printf('%02d:%02d', event_id // 60, event_id % 60) AS mmss,
 CASE WHEN event_id < 6000 THEN printf('%d.%02ds', event_id // 100, event_id % 100) ELSE printf('%dm %ds', event_id // 6000, event_id // 100 % 60) END AS short FROM events""")
def str_time_formats(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", X.clock(e).alias("clock"), X.minutes_seconds(e).alias("mmss"), X.short_duration(e).alias("short"))


@query("str_vtt_time", "SELECT event_id, event_id * 1000000 + (event_id % 1000) * 1000 AS us FROM events")
def str_vtt_time(spark, d):
    e = F.col("event_id")
    stamp = F.format_string("%02d:%02d:%02d,%03d", F.floor(e / 3600), F.floor(e / 60) % 60, e % 60, e % 1000)
    return read(spark, d, "events").withColumn("stamp", stamp).select("event_id", X.vtt_micros("stamp").alias("us"))


@query("str_split_speaker", "SELECT conv_id, turn, role AS speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM conversations")
def str_split_speaker(spark, d):
    line = F.concat("role", F.lit(" : "), X.clean_text(F.col("text")))
    return read(spark, d, "conversations").select("conv_id", "turn", *X.split_speaker(line))


@query("str_replace_literal", "SELECT page_id, regexp_replace(url, '(?i)\\.EXAMPLE', '.test', 'g') AS u, contains(lower(html), 'the') AS found FROM pages")
def str_replace_literal(spark, d):
    return read(spark, d, "pages").select("page_id", X.replace_literal(F.col("url"), ".EXAMPLE", ".test").alias("u"), F.contains(F.lower("html"), F.lit("the")).alias("found"))


@query("str_sentence", "SELECT conv_id, turn, CASE WHEN regexp_matches(s, '[.!?]$') OR s = '' THEN s ELSE s || '.' END AS s FROM (SELECT conv_id, turn, upper(t[1:1]) || t[2:] AS s FROM (SELECT conv_id, turn, regexp_replace(trim(replace(text, chr(10), ' ')), '\\s+([.,!?;:])', '\\1', 'g') AS t FROM conversations))")
def str_sentence(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.sentence(F.replace("text", F.lit("\n"), F.lit(" "))).alias("s"))


@query("str_url_id", "SELECT page_id, NULLIF(regexp_extract(url || '?v=' || CAST(page_id AS VARCHAR) || '&t=3', '[?&]v=([^&#]+)', 1), '') AS vid, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def str_url_id(spark, d):
    url = F.concat("url", F.lit("?v="), F.col("page_id").cast("string"), F.lit("&t=3"))
    return read(spark, d, "pages").select("page_id", X.query_value(url, "v").alias("vid"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("str_rouge_words", "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n FROM conversations")
def str_rouge_words(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(X.rouge_words(F.col("text"))).alias("n"))


@query("str_json_in_text", "SELECT event_id, props AS j FROM events WHERE props LIKE '{%}'")
def str_json_in_text(spark, d):
    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))
    return read(spark, d, "events").where("props like '{%}'").select("event_id", X.json_object_in(fenced).alias("j"))


@query("str_plain_transcript", "SELECT conv_id, STRING_AGG(printf('[%02d:%02d] %s: %s', turn // 60, turn % 60, role, trim(regexp_replace(text, '\\s+', ' ', 'g'))), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id")
def str_plain_transcript(spark, d):
    from turnlake.sources.sinks import plain_transcript

    lines = read(spark, d, "conversations").select("conv_id", (F.col("turn") * 1_000_000).alias("start_us"), F.col("role").alias("speaker"), "text")
    return plain_transcript(lines, "conv_id", "t")


@query("str_head_and_tail", "SELECT doc_id, CASE WHEN length(text) > 101 THEN left(text, 50) || ' ... ' || right(text, 51) ELSE text END AS t FROM documents")
def str_head_and_tail(spark, d):
    return docs(spark, d).select("doc_id", X.head_and_tail(F.col("text"), 101).alias("t"))


@query("str_natural_order", "SELECT source, CAST(ROW_NUMBER() OVER (ORDER BY CAST(substr(source, 4) AS INTEGER)) AS INTEGER) AS n FROM (SELECT DISTINCT source FROM documents WHERE source LIKE 'src%')")
def str_natural_order(spark, d):
    from turnlake.operators.ranking import ranked

    names = docs(spark, d).where("source like 'src%'").select("source").distinct()
    return ranked(names.withColumn("k", X.natural_key(F.col("source"))), [], ["k"], "n").select("source", "n")


@query("str_phrase_filters", "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'subscribe') AS junk, (contains(trim(lower(text)), 'worthless') OR trim(lower(text)) IN ('unk', 'ok')) AS hallucinated FROM documents")
def str_phrase_filters(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", M.contains_any(t, ["license", "subscribe"]).alias("junk"), X.phrase_hit(t, ["worthless"], ["unk", "ok"]).alias("hallucinated"))


@query("sc_safe_double", "SELECT event_id, COALESCE(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), -1) AS v FROM events")
def sc_safe_double(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("event_id").cast("string"))
    return read(spark, d, "events").withColumn("raw", raw).select("event_id", S.safe_double("raw", -1.0).alias("v"))


@query("sc_tiers", "SELECT p_partkey, CASE WHEN p_size = 0 THEN 'tier_A_0pct' WHEN p_size BETWEEN 5 AND 10 THEN 'tier_B_5_10pct' WHEN p_size = 15 THEN 'tier_C_15pct' ELSE 'tier_D_20_30pct' END AS tier, LEAST(p_size, 4) AS cap, [10, 20, 30][LEAST(p_size % 6 + 1, 3)] AS phase FROM part")
def sc_tiers(spark, d):
    size = F.col("p_size")
    p = read(spark, d, "part").withColumn("phases", F.array(F.lit(10), F.lit(20), F.lit(30)))
    return p.select("p_partkey", S.overlap_tier(size).alias("tier"), S.capped(size, 4).alias("cap"), S.phase_value("phases", size % 6).alias("phase"))


@query("sc_threshold_grid", "SELECT t / 10000.0 AS threshold FROM (SELECT unnest(range(500, 4501, 500)) AS t)")
def sc_threshold_grid(spark, d):
    return spark.range(1).select(F.explode(S.threshold_grid(500, 4500, 500)).alias("t")).select((F.col("t") / 10000).alias("threshold"))


@query("sc_alias_keys", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN NULL ELSE 'c' END AS present, CASE event_id % 3 WHEN 0 THEN 'a' ELSE 'c' END AS filled FROM events")
def sc_alias_keys(spark, d):
    record = F.expr("case event_id % 3 when 0 then map('speaker', 'a', 'name', 'c') when 1 then map('speaker', cast(null as string), 'name', 'c') else map('name', 'c') end")
    names = ["speaker", "spk", "name"]
    return read(spark, d, "events").withColumn("r", record).select("event_id", S.first_present("r", names).alias("present"), S.first_filled("r", names).alias("filled"))


@query("sc_nested_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, COALESCE(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), 0) AS m FROM events")
def sc_nested_json(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").cast("long"), F.lit(0)).cast("long").alias("m"))


@query("sc_sampling_weight", "SELECT doc_id, 2.0 / COUNT(*) OVER (PARTITION BY source) AS w FROM documents")
def sc_sampling_weight(spark, d):
    from turnlake.operators.sampling import weights

    return weights(docs(spark, d), "source", F.lit(2.0)).select("doc_id", F.col("weight").alias("w"))


@query("sc_meetings_needed", "SELECT p_partkey, GREATEST(1, CAST(ceil(p_size * 60 / 45.0) AS BIGINT)) AS n FROM part")
def sc_meetings_needed(spark, d):
    return read(spark, d, "part").select("p_partkey", S.meetings_needed(F.col("p_size"), F.lit(45)).alias("n"))


@query("sc_dataset_alias", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def sc_dataset_alias(spark, d):
    return docs(spark, d).where(F.col("source").isin("src1", "src3", "src5")).select("doc_id")


SCORE = "0.35 * (n_chars % 2) + 0.35 * (n_chars % 5 / 4.0) + 0.15 * (1 - (n_chars % 3 / 2.0)) + 0.15 * CASE WHEN n_chars % 90 <= 30 THEN 1.0 ELSE GREATEST(0.0, 1 - (n_chars % 90 - 30) / 50.0) END"


@query("sc_quality_score", f"SELECT doc_id, CAST(round(100000 * CAST(s AS DOUBLE)) AS BIGINT) AS score, CASE WHEN s >= 0.75 THEN 'good' WHEN s >= 0.55 THEN 'usable' ELSE 'needs_review' END AS label FROM (SELECT doc_id, round(CAST({SCORE} AS DOUBLE), 9) AS s FROM documents)")
def sc_quality_score(spark, d):
    n = F.col("n_chars")
    scored = docs(spark, d).select("doc_id", F.round(S.quality_score(n % 2, n % 5 / 4, n % 3 / 2, n % 90), 9).alias("s"))
    return scored.select("doc_id", F.round(100_000 * F.col("s")).cast("long").alias("score"), S.quality_label(F.col("s")).alias("label"))


@query("sc_quality_with_reference", f"SELECT doc_id, round(CASE WHEN n_chars % 7 = 0 THEN s ELSE 0.25 * s + 0.35 * (n_chars % 7 / 6.0::DOUBLE) + 0.40 * CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars % 4 / 3.0::DOUBLE END END, 6) AS score FROM (SELECT doc_id, n_chars, CAST({SCORE} AS DOUBLE) AS s FROM documents)")
def sc_quality_with_reference(spark, d):
    """The score drawn to ROUGE-L; every seventh document has no reference, every fourth no speaker's."""
    n = F.col("n_chars")
    plain = S.quality_score(n % 2, n % 5 / 4, n % 3 / 2, n % 90)
    rouge, speakers = F.when(n % 7 != 0, n % 7 / 6), F.when(n % 4 != 0, n % 4 / 3)
    return docs(spark, d).select("doc_id", F.round(S.quality_score_with_reference(plain, rouge, speakers), 6).alias("score"))


@query("sc_folders_and_buckets", "SELECT p_partkey, CASE WHEN p_size <= 4 THEN 'spk' || CAST(p_size AS VARCHAR) ELSE 'spk5plus' END AS folder, CASE p_partkey % 4 WHEN 0 THEN 'gold_real' WHEN 1 THEN 'hard_real' ELSE 'silver_real' END AS bucket FROM part")
def sc_folders_and_buckets(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("vif", "coi_mo", "dustin", "another"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", S.speaker_folder(F.col("p_size")).alias("folder"), S.class_bucket(name).alias("bucket"))


SENTENCES = """WITH t AS (SELECT conv_id, list(trim(text, chr(9) || chr(10) || chr(13) || ' ') ORDER BY turn) AS w FROM conversations WHERE regexp_matches(COALESCE(text, ''), '\\S') GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN '' WHEN NOT regexp_matches(w[i - 1], '[.?!,:;]$') AND upper(x[1]) = x[1] AND lower(x[1]) <> x[1] THEN '. ' ELSE ' ' END || x), '') AS said FROM t"""


@query("str_joined_sentences", SENTENCES)
def str_joined_sentences(spark, d):
    """A conversation's turns as one text."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    c = read(spark, d, "conversations").groupBy("conv_id").agg(texts.alias("texts"))
    return c.select("conv_id", X.joined_sentences(F.col("texts")).alias("said")).where("said <> ''")
