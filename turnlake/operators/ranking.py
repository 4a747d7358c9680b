"""Numbering and picking rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """A running number per key; without keys the whole frame is one group, for small frames."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return ranked(df, keys, order, "_n").where("_n = 1").drop("_n")


def nearest(df: DataFrame, keys: list[str], distance: Column, n: int, tie: str) -> DataFrame:
    """The n rows per key with the smallest distance."""
    return ranked(df.withColumn("_d", distance), keys, ["_d", tie], "_n").where(F.col("_n") <= n).drop("_n", "_d")


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order, kept sorted; a top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def pick(df: DataFrame, keys: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """One row per key, drawn by a keyed hash of the id."""
    return first_per_key(df, keys, [F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col])
