"""The columns of op2, op3, op4, op7 and op9 that SQL can express, as queries of their own with their SQL. Each
takes them from the operator's whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, mixing, quality, secret_scan, sharding
from .common import documents
from .prefix_trie import CRC_TABLE, crc_sql

LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = "regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')"


def llm_license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE = f"""WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) v(phrase, label)),
u AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w), h AS (SELECT doc_id, i, label FROM u JOIN p ON w[i + 1] = phrase[1] AND w[i + 1:i + len(phrase)] = phrase),
g AS (SELECT doc_id, COUNT(*) AS n, MIN(i) AS a, MAX(i) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, COALESCE(labels, '') AS base_labels FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""


def llm_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY = f"""WITH w AS (SELECT doc_id, COALESCE(text, '') AS t, {PLAIN_WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2), x AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM u),
r AS (SELECT doc_id, COUNT(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM x WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, COUNT(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
d AS (SELECT doc_id, SUM(again) AS n FROM l GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, COALESCE(d.n, 0) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN d ON w.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""


def llm_secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex")


ASSIGN_SQL = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET = f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(COALESCE(text, ''), '{ASSIGN_SQL}', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign, CAST(len(list_filter(regexp_extract_all(COALESCE(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
 CAST(len(list_filter(regexp_extract_all(COALESCE(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM documents"""


def llm_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of all documents."""
    rows = mixing.digest(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: Sources whose cap is below their share are those of least cap by weight: the level is found over their order.
MIXING = f"""WITH d AS (SELECT doc_id, source, len({PLAIN_WORDS}) AS size FROM documents), s AS (SELECT source, SUM(size) AS size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s), t AS (SELECT SUM(size)::DOUBLE AS whole FROM s),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY 3.0::DOUBLE * size / w, source NULLS LAST) AS place, 3.0::DOUBLE * size / w AS level, whole - COALESCE(SUM(3 * size) OVER (ORDER BY 3.0::DOUBLE * size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, SUM(w) OVER (ORDER BY 3.0::DOUBLE * size / w DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight FROM r, t),
v AS (SELECT ARG_MIN(rest / weight, place) AS share FROM o WHERE level >= rest / weight)
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(o.size AS BIGINT) AS source_size, round(LEAST(3 * o.size, share * w)::DOUBLE, 3) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN v"""


def llm_sharding_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law")


SHARDING = f"WITH {CRC_TABLE}, d AS (SELECT doc_id, COALESCE(text, '') AS x FROM documents) SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size, CAST({crc_sql('x')} AS BIGINT) AS text_crc32, 'rows' AS law FROM d, crc_table"


def llm_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, least and largest slot of every shard that has some."""
    placed = sharding.digest(documents(spark, sf_dir))
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


SHARD_COUNTS = "SELECT CAST(k AS INTEGER) AS shard, n, n AS slots, CAST(0 AS BIGINT) AS first, n - 1 AS last FROM (SELECT k, (SELECT COUNT(*) FROM documents) * (k + 1) // 16 - (SELECT COUNT(*) FROM documents) * k // 16 AS n FROM range(0, 16) r(k)) WHERE n > 0"

QUERIES = {f.__name__: f for f in (llm_license_base, llm_quality_base, llm_secret_base, llm_mixing_targets, llm_sharding_base, llm_shard_counts)}
ORACLE_SQL = {
    "llm_license_base": LICENSE,
    "llm_quality_base": QUALITY,
    "llm_secret_base": SECRET,
    "llm_mixing_targets": MIXING,
    "llm_sharding_base": SHARDING,
    "llm_shard_counts": SHARD_COUNTS,
}
