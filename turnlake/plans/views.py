"""Views over the driver's tables that stand for recordings, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = """segments AS (SELECT event_id AS seg_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS file_id, CAST(user_id % 4 AS VARCHAR) AS speaker,
 epoch_us(ts) AS start_us, epoch_us(ts) + CAST(floor(value * 100 + 0.5) AS BIGINT) * 10000 AS end_us FROM events)"""
#: The same with times from midnight of the recording's day.
LOCAL = (
    SEGMENTS
    + """, local AS (SELECT seg_id, file_id, speaker, start_us - epoch_us(CAST(file_id AS TIMESTAMP)) AS start_us, end_us - epoch_us(CAST(file_id AS TIMESTAMP)) AS end_us FROM segments)"""
)
HYP = (
    SEGMENTS
    + """, hyp AS (SELECT seg_id, file_id, CASE WHEN seg_id % 13 = 0 THEN CAST((CAST(speaker AS BIGINT) + 1) % 4 AS VARCHAR) ELSE speaker END AS speaker,
 start_us + (seg_id % 7 - 3) * 500000 AS start_us, end_us + (seg_id % 7 - 3) * 500000 AS end_us FROM segments WHERE seg_id % 11 <> 0)"""
)
TURNS = """turns AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS words FROM conversations),
 lines AS (SELECT conv_id AS file_id, turn AS seg_id, role AS speaker, text, words, CAST(SUM(len(words)) OVER (PARTITION BY conv_id ORDER BY turn) * 400000 AS BIGINT) AS end_us, CAST(len(words) * 400000 AS BIGINT) AS dur FROM turns),
 ref AS (SELECT file_id, seg_id, speaker, text, words, end_us - dur AS start_us, end_us FROM lines WHERE len(words) > 0)"""
HYP_LINES = (
    TURNS
    + """, hypl AS (SELECT file_id, file_id * 1000 + seg_id AS hyp_id, speaker, start_us + 700000 AS start_us, end_us + 700000 AS end_us,
 list_filter(list_transform(generate_series(1, len(words)), lambda i: CASE WHEN i % 7 = 0 THEN NULL ELSE words[i] END), lambda x: x IS NOT NULL) AS words FROM ref)"""
)
DAY_US = 86_400_000_000


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return read(spark, d, "events").select(
        F.col("event_id").alias("seg_id"),
        F.col("ts").cast("date").cast("string").alias("file_id"),
        (F.col("user_id") % 4).cast("string").alias("speaker"),
        start.alias("start_us"),
        (start + F.floor(F.col("value") * 100 + 0.5).cast("long") * 10000).alias("end_us"),
    )


def local(spark: SparkSession, d: str) -> DataFrame:
    midnight = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(file_id as timestamp_ntz))")
    return segments(spark, d).select("seg_id", "file_id", "speaker", (F.col("start_us") - midnight).alias("start_us"), (F.col("end_us") - midnight).alias("end_us"))


def hyp(spark: SparkSession, d: str) -> DataFrame:
    moved = (F.col("seg_id") % 7 - 3) * 500_000
    other = ((F.col("speaker").cast("long") + 1) % 4).cast("string")
    return segments(spark, d).where("seg_id % 11 <> 0").select("seg_id", "file_id", F.when(F.col("seg_id") % 13 == 0, other).otherwise(F.col("speaker")).alias("speaker"), (F.col("start_us") + moved).alias("start_us"), (F.col("end_us") + moved).alias("end_us"))


def ref(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as reference lines; 400 ms a word."""
    from pyspark.sql import Window

    words = F.expr(r"filter(split(lower(text), '\\s+'), x -> x <> '')")
    turns = read(spark, d, "conversations").withColumn("words", words)
    end = F.sum(F.size("words")).over(Window.partitionBy("conv_id").orderBy("turn")) * 400_000
    lines = turns.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_id"), F.col("role").alias("speaker"), "text", "words", end.alias("end_us"))
    return lines.where("size(words) > 0").withColumn("start_us", F.col("end_us") - F.size("words") * 400_000)


def hyp_lines(spark: SparkSession, d: str) -> DataFrame:
    """Reference lines moved by 700 ms, every seventh word left out."""
    return ref(spark, d).select("file_id", (F.col("file_id") * 1000 + F.col("seg_id")).alias("hyp_id"), "speaker", (F.col("start_us") + 700_000).alias("start_us"), (F.col("end_us") + 700_000).alias("end_us"), F.expr("filter(words, (x, i) -> (i + 1) % 7 <> 0)").alias("words"))


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


def islands_sql(source: str, keys: str, gap: int = 0, name: str = "isl") -> str:
    """CTEs that end in name(keys, start_us, end_us, n_segments)."""
    return f"""{name}_a AS (SELECT *, MAX(end_us) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {source}),
 {name}_b AS (SELECT *, SUM(CASE WHEN seen IS NULL OR start_us > seen + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}_a),
 {name} AS (SELECT {keys}, MIN(start_us) AS start_us, MAX(end_us) AS end_us, COUNT(*) AS n_segments FROM {name}_b GROUP BY {keys}, island)"""


def steps_sql(source: str, keys: str = "file_id", name: str = "steps") -> str:
    """CTEs that end in name(keys, start_us, end_us, active)."""
    return f"""{name}_m AS (SELECT {keys}, start_us AS t, 1 AS d FROM {source} UNION ALL SELECT {keys}, end_us, -1 FROM {source}),
 {name}_s AS (SELECT {keys}, t, SUM(d) AS d FROM {name}_m GROUP BY {keys}, t),
 {name}_l AS (SELECT {keys}, t AS start_us, LEAD(t) OVER (PARTITION BY {keys} ORDER BY t) AS end_us, CAST(SUM(d) OVER (PARTITION BY {keys} ORDER BY t) AS BIGINT) AS active FROM {name}_s),
 {name} AS (SELECT * FROM {name}_l WHERE end_us IS NOT NULL)"""
