"""Deterministic samples and splits: the order of a keyed MD5 stands for a seeded shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: str, seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


#: Ranges of the order key that running sums are cut into, by its first hex digits.
RANGE_DIGITS = 3


def running_before(items: DataFrame, group: list[str], key: str, amount: Column, seed: int, name: str) -> DataFrame:
    """Adds the sum of the amounts before a row in its group's hash order. Sums of 16^RANGE_DIGITS ranges of
    the order are added up first, so a group is as many tasks as it has ranges, and no task a group."""
    order = order_key(key, seed)
    parted = items.withColumn("_order", order).withColumn("_range", F.substring(order, 1, RANGE_DIGITS)).withColumn("_amount", amount)
    sums = parted.groupBy(*group, "_range").agg(F.sum("_amount").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*(F.col(g).alias(f"_b_{g}") for g in group), F.col("_range").alias("_b_range"), F.coalesce(earlier, F.lit(0)).alias("_base"))
    inside = F.sum("_amount").over(Window.partitionBy(*group, "_range").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, -1))
    met = F.expr(" and ".join([*(f"`{g}` <=> `_b_{g}`" for g in group), "_range = _b_range"]))
    joined = parted.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(bases, met)
    return joined.withColumn(name, F.col("_base") + F.col("_inside")).select(*items.columns, name)


def split_train_val(items: DataFrame, group: list[str], key: str, percent: int, seed: int = 42, least_train: int = 1) -> DataFrame:
    """Adds part: per group max(0, min(n * percent / 100, n - least_train)) rows are 'val'."""
    counts = items.groupBy(*group).agg(F.count("*").alias("_n")).select(*(F.col(g).alias(f"_c_{g}") for g in group), "_n")
    ranked = running_before(items, group, key, F.lit(1), seed, "_rank").join(counts, F.expr(" and ".join(f"`{g}` <=> `_c_{g}`" for g in group)))
    n_val = F.greatest(F.lit(0), F.least(F.floor(F.col("_n") * percent / 100), F.col("_n") - least_train))
    return ranked.withColumn("part", F.when(F.col("_rank") < n_val, "val").otherwise("train")).select(*items.columns, "part")


def round_robin(items: DataFrame, strata: list[str], order: str, n: int) -> DataFrame:
    """n rows, one of each stratum in turn. Ranks beyond n never count, so strata are cut first."""
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("_r") <= n)
    return ranked.orderBy("_r", *strata).limit(n).drop("_r")


def until_target(items: DataFrame, group: list[str], key: str, amount: str, target: Column, seed: int = 42) -> DataFrame:
    """Rows in hash order per group until the amounts before a row reach the target."""
    return running_before(items, group, key, F.col(amount), seed, "_before").where(F.col("_before") < target).drop("_before")


def per_group(items: DataFrame, group: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group at most, in hash order."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order_key(key, seed), key))).where(F.col("_r") <= n).drop("_r")


def weights(items: DataFrame, source: str, mix: Column) -> DataFrame:
    """Adds weight: the source's share over its number of rows. Counts join back by source, so a large
    source is no single task."""
    counts = items.groupBy(source).agg(F.count("*").alias("_n"))
    return items.join(counts, items[source].eqNullSafe(counts[source])).withColumn("weight", mix / F.col("_n")).drop("_n").drop(counts[source])


def uniform(key: Column, seed: int, bits: int = 52) -> Column:
    """A number in (0, 1) from a keyed hash, the same wherever the row lies."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 64 - bits) + 0.5) / F.lit(float(1 << bits))


def with_replacement(items: DataFrame, source: str, mix: Column, draws: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """About draws rows: every row as often as a Poisson number of its weight's share says, from keyed
    hashes, so reruns agree. Rows of one key draw alike."""
    weighed = weights(items, source, mix)
    total = weighed.agg(F.coalesce(F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0)).alias("_total"))
    rated = weighed.join(F.broadcast(total)).withColumn("_rate", F.col("weight") / F.col("_total") * draws)  # one row
    # A Poisson number is the number of steps of a unit exponential clock within its rate, so it is a sum of
    # independent ones for parts of the rate of one at most; each part counts its own steps.
    parts = F.greatest(F.lit(1).cast("long"), F.ceil("_rate"))
    cut = rated.withColumn("_share", F.col("_rate") / parts).withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), parts)))
    u = uniform(F.struct(F.col(key), F.col("_part")), seed)
    # The inverse of the distribution: terms are added until they cover u; 40 of a rate of one reach 1 - 1e-48.
    fold = "aggregate(sequence(1, 40), named_struct('t', exp(-_share), 'c', exp(-_share), 'n', 0), (a, k) -> if(_u > a.c, named_struct('t', a.t * _share / k, 'c', a.c + a.t * _share / k, 'n', k), a)).n"
    times = cut.withColumn("_u", u).withColumn("_times", F.expr(fold)).where("_times > 0")
    return times.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*items.columns)
