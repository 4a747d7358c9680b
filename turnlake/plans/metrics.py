"""Queries of alignment, diarization and vector metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import metrics as M
from turnlake.operators import vectors as V
from turnlake.plans.joins import MATCHES, assigned
from turnlake.plans.views import HYP, HYP_LINES, hyp, islands_sql, read, segments, sql
from turnlake.registry import query

#: Least cosine of a member to its centroid in met_purified.
PURE = 0.5
DP = """CASE WHEN len({a}) = 0 THEN len({b}) WHEN len({b}) = 0 THEN len({a}) ELSE list_reduce(list_concat([generate_series(0, len({b}))], list_transform({a}, lambda x: [CASE WHEN x = y THEN 0 ELSE 1 END for y in {b}])),
 lambda prev, row: list_reduce(list_concat([[prev[1] + 1]], list_transform(generate_series(1, len(row)), lambda j: [prev[j + 1] + 1, prev[j] + row[j]])), lambda cur, c: list_append(cur, LEAST(c[1], c[2], cur[len(cur)] + 1))))[-1] END"""


@query("met_edit_distance", sql(HYP_LINES, MATCHES, select=f"SELECT hyp_id, CAST({DP.format(a='ref_words', b='words')} AS INTEGER) AS edits, CAST(len(ref_words) AS INTEGER) AS n_words FROM assigned"))
def met_edit_distance(spark, d):
    return assigned(spark, d).select("hyp_id", M.edit_distance("ref_words", "words").alias("edits"), F.size("ref_words").alias("n_words"))


@query("met_wer_groups", sql(HYP_LINES, MATCHES, f"e AS (SELECT file_id, speaker, {DP.format(a='ref_words', b='words')} AS edits, len(ref_words) AS n FROM assigned)", select="SELECT speaker, CAST(SUM(edits) AS BIGINT) AS edits, CAST(SUM(n) AS BIGINT) AS n_words, CAST(SUM(edits) AS DOUBLE) / GREATEST(SUM(n), 1) AS wer FROM e GROUP BY speaker"))
def met_wer_groups(spark, d):
    scored = assigned(spark, d).select("speaker", M.edit_distance("ref_words", "words").alias("edits"), F.size("ref_words").alias("n_words"))
    sums = scored.groupBy("speaker").agg(F.sum("edits").alias("edits"), F.sum("n_words").alias("n_words"))
    return sums.withColumn("wer", F.col("edits") / F.greatest(F.col("n_words"), F.lit(1)))


@query("met_word_errors")
def met_word_errors(spark, d):
    e = assigned(spark, d).withColumn("e", M.word_errors("ref_words", "words"))
    return e.select("hyp_id", "e.substitutions", "e.deletions", "e.insertions")


LCS = """CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce(list_concat([list_transform(generate_series(0, len({b})), lambda z: 0)], list_transform({a}, lambda x: [CASE WHEN x = y THEN 1 ELSE 0 END for y in {b}])),
 lambda prev, row: list_reduce(list_concat([[0]], list_transform(generate_series(1, len(row)), lambda j: [prev[j + 1], prev[j], row[j]])), lambda cur, c: list_append(cur, CASE WHEN c[3] = 1 THEN c[2] + 1 ELSE GREATEST(c[1], cur[len(cur)]) END)))[-1] END"""


@query("met_rouge_l", sql(HYP_LINES, MATCHES, f"r AS (SELECT hyp_id, len(ref_words) AS n, len(words) AS m, {LCS.format(a='ref_words', b='words')} AS l FROM assigned)", select="SELECT hyp_id, CASE WHEN n = 0 OR m = 0 OR l = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * l / (n + m) END AS rouge_l FROM r"))
def met_rouge_l(spark, d):
    return assigned(spark, d).select("hyp_id", M.rouge_l("ref_words", "words").alias("rouge_l"))


@query("met_token_similarity", sql(HYP_LINES, MATCHES, select="SELECT hyp_id, CASE WHEN len(ref_words) = 0 OR len(words) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(ref_words), list_distinct(words)))::DOUBLE / GREATEST(len(list_distinct(ref_words)), len(list_distinct(words))) END AS sim FROM assigned"))
def met_token_similarity(spark, d):
    return assigned(spark, d).select("hyp_id", M.token_similarity("ref_words", "words").alias("sim"))


@query("met_repeats_or_rushes", sql(HYP_LINES, select="SELECT hyp_id, len(words) > 8 * ((end_us - start_us) / 2400000.0) OR (len(words) >= 8 AND words[1:len(words) // 2] = words[len(words) // 2 + 1:len(words) // 2 * 2]) AS flagged FROM hypl"))
def met_repeats_or_rushes(spark, d):
    from turnlake.plans.views import hyp_lines

    return hyp_lines(spark, d).select("hyp_id", M.repeats_or_rushes("words", (F.col("end_us") - F.col("start_us")) / 2_400_000.0).alias("flagged"))


@query("met_compression_ratio")
def met_compression_ratio(spark, d):
    return read(spark, d, "documents").select("doc_id", (M.compression_ratio("text") > 2.4).alias("repetitive"))


DER = [
    islands_sql("segments", "file_id, speaker", name="rs"),
    islands_sql("hyp", "file_id, speaker", name="hs"),
    "pts AS (SELECT file_id, start_us AS t FROM rs UNION SELECT file_id, end_us FROM rs UNION SELECT file_id, start_us FROM hs UNION SELECT file_id, end_us FROM hs), iv AS (SELECT * FROM (SELECT file_id, t AS t0, LEAD(t) OVER (PARTITION BY file_id ORDER BY t) AS t1 FROM pts) WHERE t1 IS NOT NULL)",
    """act AS (SELECT i.file_id, t0, t1, speaker, MAX(r) AS r, MAX(h) AS h FROM (SELECT i.file_id, t0, t1, s.speaker, 1 AS r, 0 AS h FROM iv i JOIN rs s ON i.file_id = s.file_id AND s.start_us <= i.t0 AND s.end_us >= i.t1 UNION ALL
 SELECT i.file_id, t0, t1, s.speaker, 0, 1 FROM iv i JOIN hs s ON i.file_id = s.file_id AND s.start_us <= i.t0 AND s.end_us >= i.t1) i GROUP BY ALL), c AS (SELECT file_id, t1 - t0 AS d, SUM(r) AS nr, SUM(h) AS nh, SUM(r * h) AS nc FROM act GROUP BY file_id, t0, t1)""",
]


@query("met_der", sql(HYP, *DER, select="""SELECT file_id, CAST(SUM(d * nr) AS BIGINT) AS ref_us, CAST(SUM(d * GREATEST(0, nr - nh)) AS BIGINT) AS miss_us, CAST(SUM(d * GREATEST(0, nh - nr)) AS BIGINT) AS fa_us, CAST(SUM(d * (LEAST(nr, nh) - nc)) AS BIGINT) AS conf_us,
 CAST(SUM(CASE WHEN nr >= 2 AND nh >= 2 THEN d ELSE 0 END) AS BIGINT) AS ov_both_us, CAST(SUM(CASE WHEN nh >= 2 THEN d ELSE 0 END) AS BIGINT) AS ov_hyp_us, CAST(SUM(CASE WHEN nr >= 2 THEN d ELSE 0 END) AS BIGINT) AS ov_ref_us FROM c GROUP BY file_id"""))
def met_der(spark, d):
    return M.der(segments(spark, d), hyp(spark, d))


#: Best mapping of up to four speakers of a side by trying all orders: hm are the hypothesis' segments.
BEST_SHARED = [
    islands_sql("hm", "file_id, speaker", name="ms"),
    "hx AS (SELECT file_id, speaker, DENSE_RANK() OVER (PARTITION BY file_id ORDER BY speaker) AS k FROM (SELECT DISTINCT file_id, speaker FROM ms)), rx AS (SELECT file_id, speaker, DENSE_RANK() OVER (PARTITION BY file_id ORDER BY speaker) AS k FROM (SELECT DISTINCT file_id, speaker FROM rs))",
    "cooc AS (SELECT h.file_id, hx.k AS hk, rx.k AS rk, SUM(LEAST(h.end_us, r.end_us) - GREATEST(h.start_us, r.start_us)) AS v FROM ms h JOIN rs r ON h.file_id = r.file_id AND h.start_us < r.end_us AND r.start_us < h.end_us JOIN hx ON hx.file_id = h.file_id AND hx.speaker = h.speaker JOIN rx ON rx.file_id = r.file_id AND rx.speaker = r.speaker GROUP BY ALL)",
    "perms AS (SELECT [a.x, b.x, c.x, d.x] AS p FROM range(1, 5) a(x), range(1, 5) b(x), range(1, 5) c(x), range(1, 5) d(x) WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND b.x <> c.x AND b.x <> d.x AND c.x <> d.x)",
    "bt AS (SELECT file_id, MAX(s) AS best FROM (SELECT file_id, p, SUM(v) AS s FROM cooc JOIN perms ON p[hk] = rk GROUP BY file_id, p) GROUP BY file_id)",
]
RELABELLED = "hm AS (SELECT file_id, 'x' || CAST((CAST(speaker AS BIGINT) + CAST(right(file_id, 2) AS BIGINT)) % 4 AS VARCHAR) AS speaker, start_us, end_us FROM hyp)"


@query("met_der_mapped", sql(HYP, *DER, RELABELLED, *BEST_SHARED, select="SELECT c.file_id, CAST(SUM(d * nr) AS BIGINT) AS ref_us, CAST(SUM(d * GREATEST(0, nr - nh)) AS BIGINT) AS miss_us, CAST(SUM(d * GREATEST(0, nh - nr)) AS BIGINT) AS fa_us, CAST(SUM(d * LEAST(nr, nh)) - COALESCE(ANY_VALUE(best), 0) AS BIGINT) AS conf_us FROM c LEFT JOIN bt ON c.file_id = bt.file_id GROUP BY c.file_id"))
def met_der_mapped(spark, d):
    """DER of a hypothesis whose speakers have names of its own, others in every recording."""
    named = F.concat(F.lit("x"), ((F.col("speaker").cast("long") + F.substring("file_id", -2, 2).cast("long")) % 4).cast("string"))
    return M.der_mapped(segments(spark, d), hyp(spark, d).withColumn("speaker", named)).select("file_id", "ref_us", "miss_us", "fa_us", "conf_us")


@query("met_speaker_mapping")
def met_speaker_mapping(spark, d):
    return M.speaker_mapping(segments(spark, d), hyp(spark, d), ["file_id"])


ROLE_WORDS = """c AS (SELECT conv_id, role, turn < 2 AS early, turn, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations),
 g AS (SELECT conv_id, role, early, flatten(list(w ORDER BY turn, w)) AS w FROM c GROUP BY conv_id, role, early), b AS (SELECT f.conv_id, f.role, f.w AS a, s.w AS b FROM g f JOIN g s ON f.conv_id = s.conv_id AND f.role = s.role AND f.early AND NOT s.early)"""


@query("met_speaker_rouge", sql(ROLE_WORDS, f"r AS (SELECT conv_id, len(a) AS n, len(b) AS m, {LCS.format(a='a', b='b')} AS l FROM b)", select="SELECT conv_id, COUNT(*) AS common, AVG(CASE WHEN n = 0 OR m = 0 OR l = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * l / (n + m) END) AS rouge_l FROM r GROUP BY conv_id"))
def met_speaker_rouge(spark, d):
    """ROUGE-L between the words of a role's first turns and those of its later ones, averaged over the roles that have both."""
    c = read(spark, d, "conversations").select("conv_id", "role", "turn", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "").alias("w"))
    words = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "w"))), lambda x: x["w"]))
    first = c.where("turn < 2").groupBy("conv_id", "role").agg(words.alias("a"))
    both = first.join(c.where("turn >= 2").groupBy("conv_id", "role").agg(words.alias("b")), ["conv_id", "role"])
    return both.withColumn("rouge", M.rouge_l("a", "b")).groupBy("conv_id").agg(F.count("*").alias("common"), F.avg("rouge").alias("rouge_l"))


@query("met_centroids", """WITH c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, AVG(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
 s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS cs FROM embeddings, c) SELECT vec_id, ARG_MAX(label, cs) AS assigned FROM s GROUP BY vec_id""")
def met_centroids(spark, d):
    e = read(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centroids = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))
    return M.centroid_assignment(e, centroids).select("vec_id", "assigned")


@query("met_snr", "SELECT vec_id, round(10 * log10(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x)) / 2), 6) AS snr FROM embeddings")
def met_snr(spark, d):
    e = read(spark, d, "embeddings").withColumn("noise", F.slice("embedding", 1, 32))
    return e.select("vec_id", F.round(M.snr_db("embedding", "noise"), 6).alias("snr"))


@query("met_purified")
def met_purified(spark, d):
    """Vectors of two recordings (even and odd ids), every seventh under a wrong label, every fifth without one:
    purified by label, the rest labelled like their nearest member."""
    e = read(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    state = V.purify(e.select((F.col("vec_id") % 2).alias("rec"), "vec_id", "embedding", label.alias("label")), ["rec"], PURE)
    named = V.propagate(state, ["rec"]).select("rec", "vec_id", "assigned")
    return named.join(state.select("rec", "vec_id", "member", "dropped_in"), ["rec", "vec_id"])
