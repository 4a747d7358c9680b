"""Rollups. Ratios of sums (micro) and means of values (macro) are different operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.joins import range_join, right_side
from turnlake.operators.shared import carried, durable, same


def wer_rollup(segments: DataFrame, file: str, group: str) -> DataFrame:
    """Sums of edits and words per file, per group and in all; level 0, 1, 3. The rate is edits over
    words, one word at least."""
    out = segments.groupingSets([[F.col(group), F.col(file)], [F.col(group)], []], group, file)
    sums = out.agg(F.sum("edits").alias("edits"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_segments"), F.grouping_id(group, file).cast("int").alias("level"))
    return sums.withColumn("wer", F.col("edits") / F.greatest(F.col("n_words"), F.lit(1)))


def mean_of_means(rows: DataFrame, case: str, scores: list[str]) -> DataFrame:
    """Missing scores count as 0; mean per case, then over cases."""
    per_case = rows.groupBy(case).agg(*(F.avg(F.coalesce(s, F.lit(0.0))).alias(s) for s in scores))
    return per_case.agg(F.count("*").alias("cases"), *(F.avg(s).alias(s) for s in scores))


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum per key and its part of the whole of the first key."""
    total = rows.groupBy(*keys).agg(F.sum(value).alias(value))
    return total.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(keys[0])))


def weighted_mean(rows: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(value * weight) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def level_check(rows: DataFrame, level: str, part_us: str, whole_us: str, points: float = 3.0) -> DataFrame:
    """Percent per target level against the target: exactly 0 for 0, else within some points."""
    out = rows.groupBy(level).agg(F.sum(part_us).alias(part_us), F.sum(whole_us).alias(whole_us))
    percent = F.col(part_us) * 100 / F.col(whole_us)
    ok = F.when(F.col(level) == 0, F.col(part_us) == 0).otherwise(F.abs(percent - F.col(level)) <= points)
    return out.withColumn("percent", percent).withColumn("ok", ok)


def quantile(rows: DataFrame, keys: list[str], value: str, part: float, name: str) -> DataFrame:
    """One row per key: the exact quantile of the values that are not null, between neighbours in proportion. Equal
    values are counted first, then ranked by ranges of key and value, so no task holds a group."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__q")).agg(F.count("*").alias("__count"))
    ranged = durable(counted.repartitionByRange(*keys, "__q").withColumn("__part", F.spark_partition_id()))
    seen = carried(ranged, keys, F.col("__part"), F.col("__count"), F.sum, "__before", ["__q"]).withColumn("__before", F.coalesce("__before", F.lit(0)))
    totals = counted.groupBy(*keys).agg(F.sum("__count").alias("__all")).select(*(F.col(k).alias(f"__t_{k}") for k in keys), "__all")
    at = (F.col("__all") - 1) * F.lit(part)
    ranked = seen.join(totals, same(keys, right="__t_")).withColumn("__at", at)
    has = lambda place: (F.col("__before") <= place) & (place < F.col("__before") + F.col("__count"))
    near = ranked.where(has(F.floor("__at")) | has(F.ceil("__at")))
    picked = near.groupBy(*keys).agg(F.min("__q").alias("__low"), F.max("__q").alias("__high"), F.max(F.col("__at") - F.floor("__at")).alias("__f"))
    return picked.select(*keys, ((1 - F.col("__f")) * F.col("__low") + F.col("__f") * F.col("__high")).alias(name))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, most, exact median, mean and sample deviation per key."""
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"))
    middle = quantile(rows, keys, value, 0.5, "median").withColumnsRenamed({k: f"__m_{k}" for k in keys})
    return sums.join(middle, same(keys, right="__m_"), "left").select(*keys, "n", "least", "most", "median", "mean", "stdev")


def flag_rates(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.avg(c.cast("int")).alias(n) for n, c in flags.items()))


def missing_keys(record: str, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.map_keys(record)))


def schema_rates(record: str, required: list[str]) -> list[Column]:
    """missing (sorted), whole (none is) and pass_rate of the required keys of a map."""
    missing = missing_keys(record, required)
    return [missing.alias("missing"), (F.size(missing) == 0).alias("whole"), ((len(required) - F.size(missing)) / len(required)).alias("pass_rate")]


def evidence_rates(items: DataFrame, lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Per summary: items, and the rates of those with a valid evidence span, with one that a line of their
    speaker meets (closed ends), and whose speaker has a line. items: key, item_id, speaker, spans (arrays of
    times); lines: key, speaker, start_us, end_us. Spans of other than two times do not count. As spans are
    tried in order until one is met, a valid one behind that does not count either."""
    spans = items.select(key, "item_id", "speaker", F.posexplode("spans").alias("pos", "s")).where("size(s) = 2")
    ends = spans.select(key, "item_id", "speaker", "pos", F.col("s")[0].alias("s0"), F.col("s")[1].alias("s1"))
    # A reversed span meets what covers both of its ends; closed ends meet where half-open ones of one more do.
    wide = ends.withColumn("start_us", F.least("s0", "s1")).withColumn("end_us", F.greatest("s0", "s1") + 1)
    closed = lines.select(key, "speaker", F.col("start_us"), (F.col("end_us") + 1).alias("end_us"))
    met = range_join(wide, right_side(closed, [key]), [key]).where("speaker = r_speaker and s1 >= r_start_us and r_end_us - 1 >= s0")
    first = met.groupBy(key, "item_id").agg(F.min("pos").alias("met"))
    valid = ends.join(first, [key, "item_id"], "left").where("s1 >= s0 and (met is null or pos <= met)").select(key, "item_id").distinct().withColumn("_valid", F.lit(1))
    present = lines.select(key, "speaker").distinct().withColumn("_present", F.lit(1))
    each = items.select(key, "item_id", "speaker").join(first, [key, "item_id"], "left").join(valid, [key, "item_id"], "left").join(present, [key, "speaker"], "left")
    rate = lambda c: F.avg(F.when(c.isNotNull(), 1.0).otherwise(0.0))
    return each.groupBy(key).agg(F.count("*").alias("n_items"), rate(F.col("_valid")).alias("valid_rate"), rate(F.col("met")).alias("support_rate"), rate(F.col("_present")).alias("presence_rate"))


def fairness_weights(segments: DataFrame, keys: tuple[str, ...] = ("file_id",), slice_us: int | None = None) -> DataFrame:
    """Adds weight: 1.1 less the part of the talk so far (before the row, by start) that is the row's
    speaker's; before any talk it is 1.1. Given slice_us, windows are slices of a recording's time."""
    order = ["start_us", "end_us", "seg_id"]
    length = F.col("end_us") - F.col("start_us")
    if slice_us is None:
        before = lambda *by: F.coalesce(F.sum(length).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return segments.withColumn("weight", 1.0 - before(*keys, "speaker") / F.greatest(before(*keys), F.lit(1)) + 0.1)
    cut = F.floor(F.col("start_us") / F.lit(slice_us))
    own = carried(segments, [*keys, "speaker"], cut, length, F.sum, "_own", order)
    every = carried(own, list(keys), cut, length, F.sum, "_every", order)
    zero = F.lit(0).cast("long")
    return every.withColumn("weight", 1.0 - F.coalesce("_own", zero) / F.greatest(F.coalesce("_every", zero), F.lit(1)) + 0.1).drop("_own", "_every")
