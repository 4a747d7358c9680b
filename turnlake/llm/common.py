"""Shared helpers: durable intermediate tables, the shared folder, joins on hot keys, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the word definition used by most operators: space and \t..\r.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session makes
    one of its own; on a cluster that folder would be another on every machine, so this raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="turnlake-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: columns are pruned when it is read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows, and bytes of stored input, that a partition has at least where a frame is made of fewer of them.
PART_ROWS, PART_BYTES = 500_000, 16 << 20


def compact(df: DataFrame, stored: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """The frame in no more partitions than its size asks for, two a core at least: by a bound on its rows,
    or by the bytes of the stored table that it comes from. Every partition that is written is a file, and
    a frame of thousands of tiny ones costs more in files than in rows. Large frames stay as they are."""
    if rows is None:
        rows = 0
        size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    else:
        size = 0
    # An unknown size counts as very large.
    return df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS), -(-size // PART_BYTES))))


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; rows: a bound on its rows, if known."""
    shared_dir(df.sparkSession)
    return (df if rows is None else compact(df, rows=rows)).checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Cache:
    """A map bounded by the bytes it is charged: a lasting part (what is seen first, so the frequent keys)
    and a part that starts anew when full. Values depend on their key alone, so dropping one costs time
    only. Keys over a whole part's bytes are kept until the next room()."""

    def __init__(self, lasting: int = 24 << 20, passing: int = 8 << 20):
        self.map: dict = {}
        self.lasting, self.passing = lasting, passing
        self.held = self.passed = 0
        self.recent: list = []

    def room(self) -> None:
        """To be called between documents: drops the passing part once it is full."""
        if self.passed > self.passing:
            for k in self.recent:
                self.map.pop(k, None)
            self.recent, self.passed = [], 0

    def add(self, k, v, cost: int) -> None:
        if self.held + cost <= self.lasting:
            self.held += cost
        else:
            self.recent.append(k)
            self.passed += cost
        self.map[k] = v


_held: dict[str, Any] = {"key": None, "state": None}


def worker_state(key: tuple, make: Callable[[], Any]) -> Any:
    """The tables and caches of one operator in a Python worker. Workers are used again by later stages;
    what an earlier operator has kept goes when another one asks, so that they do not add up."""
    if _held["key"] != key:
        _held.update(key=None, state=None)
        pa.default_memory_pool().release_unused()
        _held.update(key=key, state=make())
    return _held["state"]


#: A key is hot from this part of all rows on; at most so many keys are.
HOT_SHARE = 4096


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left-joined with table (one row a key; n: how many of the total rows have it; dropped). Rows
    of hot keys, at most HOT_SHARE keys, meet a broadcast table, so no task gets a hot key's rows; the
    others are shuffled. A null key joins nothing."""
    hot = F.broadcast(table.where(F.col(n) * HOT_SHARE > total).drop(n).withColumn("__hot", F.lit(True)))
    seen = rows.join(hot, key, "left")
    rest = seen.where(F.col("__hot").isNull()).select(*rows.columns).join(table.where(F.col(n) * HOT_SHARE <= total).drop(n), key, "left")
    return seen.where("__hot").select(*rest.columns).unionByName(rest)


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of driver-made rows with known size, so that Spark broadcasts it only if it is small."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return spark.createDataFrame(table)


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a node that filters are not pushed below. Catalyst inlines projections into a
    pushed filter, and what stands inside a lambda would then be computed anew for every element."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))
