"""Durable intermediate frames in the folder that all executors share, joins on hot keys, and numbers and running
values of groups that may be larger than a task."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session makes a folder of its own; on a cluster that
    would be another one on every machine, so this raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="turnlake-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot from this part of all rows on; at most so many keys are.
HOT_SHARE = 4096


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left-joined with table (one row a key; n: how many of the total rows have it; dropped). Rows of hot
    keys, at most HOT_SHARE keys, meet a broadcast table, the others are shuffled. A null key joins nothing."""
    hot = F.broadcast(table.where(F.col(n) * HOT_SHARE > total).drop(n).withColumn("__hot", F.lit(True)))
    seen = rows.join(hot, key, "left")
    rest = seen.where(F.col("__hot").isNull()).select(*rows.columns).join(table.where(F.col(n) * HOT_SHARE <= total).drop(n), key, "left")
    return seen.where("__hot").select(*rest.columns).unionByName(rest)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns as new ones, for cogroups of frames that have a common source."""
    return df.select(*(F.col(f"`{c}`").alias(c) for c in df.columns))


def same(keys: list[str], left: str = "", right: str = "") -> Column:
    """Whether all keys are equal, nulls too, under prefixes."""
    return F.expr(" and ".join(f"`{left}{k}` <=> `{right}{k}`" for k in keys) or "true")


#: Bits that monotonically_increasing_id() has for the row in its partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place (from 0) of a row among those of its keys. Partitions are ranges of keys and order, so a
    group of any size is spread; a place is the group's rows in the ranges before and those before it in its
    own. Rows that keys and order do not tell apart stand in any order."""
    by = [*keys, *order]
    ranged = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__m", _ROW_BITS))
    sizes = ranged.groupBy(*keys, "__part").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    # One row a group and partition.
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__part").alias("__k___part"), (before - F.col("__first")).alias("__base"))
    met = ranged.join(bases, same([*keys, "__part"], right="__k_"))
    return met.withColumn(name, F.col("__m") + F.col("__base")).select(*rows.columns, name)


def carried(rows: DataFrame, keys: list[str], cut: Column, value: Column, fold, name: str, order: list | None = None, last_first: bool = False) -> DataFrame:
    """Adds fold (F.sum, F.max or F.min) of value over the rows of the same keys before a row, in order; after it,
    last_first; null if there is none. cut numbers slices of the order: a window holds a slice, and folds of the
    whole slices before it are carried in, one row a group and slice. Without order (all rows of slices before
    alone) nothing inside the slice counts."""
    sliced = rows.withColumn("__cut", cut).withColumn("__v", value)
    way = F.desc if last_first else F.asc
    folds = sliced.groupBy(*keys, "__cut").agg(fold("__v").alias("__whole"))
    outside = Window.partitionBy(*keys).orderBy(way("__cut")).rowsBetween(Window.unboundedPreceding, -1)
    bases = folds.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__cut").alias("__k___cut"), fold("__whole").over(outside).alias("__base"))
    inside = F.lit(None) if order is None else fold("__v").over(Window.partitionBy(*keys, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    met = sliced.withColumn("__inside", inside).join(bases, same([*keys, "__cut"], right="__k_"))
    both = {F.sum: F.coalesce(F.col("__base") + F.col("__inside"), "__base", "__inside"), F.max: F.greatest("__base", "__inside"), F.min: F.least("__base", "__inside")}[fold]
    return met.withColumn(name, both).select(*rows.columns, name)


#: Rows of a batch that stream_groups() gives out.
BATCH_ROWS = 10_000


def stream_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """Rows that a fold makes of each group's key and rows (tuples of the columns other than keys) in order. Groups are
    partitioned and sorted, then read as a stream, so a task holds one at a time and no group costs a call of
    its own."""
    others, width, arrow = [c for c in df.columns if c not in keys], len(keys), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, held = None, []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != now:
                    if held:
                        out.extend(fold(now, held))
                    now, held = row[:width], []
                    if len(out) > BATCH_ROWS:
                        yield batch_of()
                        out.clear()
                held.append(row[width:])
        if held:
            out.extend(fold(now, held))
        yield batch_of()

    return df.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
