"""Experiment grids: tasks, what is left of them, and rollups of their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def task_grid(*dimensions: DataFrame) -> DataFrame:
    """Every combination of the distinct rows of each dimension (each a few rows)."""
    grid = dimensions[0].distinct()
    for d in dimensions[1:]:
        grid = grid.crossJoin(d.distinct())
    return grid


def remaining(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result."""
    return grid.join(results, keys, "left_anti")


def report(cases: DataFrame, sets: list[list[str]], metrics: list[str]) -> DataFrame:
    """Unweighted means over cases at several levels, with the level's columns and the number of cases."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    aggs = [F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in metrics)]
    return cases.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggs, F.grouping_id(*columns).cast("int").alias("level"))


def pivot_by_threshold(rows: DataFrame, group: str, threshold: str, metric: str, values: list) -> DataFrame:
    """One row per group, one column per threshold."""
    return rows.groupBy(group).pivot(threshold, values).agg(F.sum(metric))


def attempt(grid: DataFrame, task: Callable[[dict], str], passes: int = 2) -> DataFrame:
    """Runs a task per row of a grid and adds result (text), error and tries. A task that raises keeps its
    error and is tried anew, passes times in all, after the others of its batch; the job itself goes on. What is
    done is lost with the executor; run_passes() keeps it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema) + ", result string, error string, tries int"
    names = grid.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            state = [{"result": None, "error": None, "tries": 0} for _ in rows]
            for _ in range(passes):
                for row, s in zip(rows, state, strict=True):
                    if s["tries"] and s["error"] is None:
                        continue
                    try:
                        s.update(result=task(dict(row)), error=None)
                    except Exception as e:  # noqa: BLE001 - a task may fail in any way, and that is its result
                        s["error"] = f"{type(e).__name__}: {e}"
                    s["tries"] += 1
            yield pd.DataFrame([{**r, **s} for r, s in zip(rows, state, strict=True)], columns=[*names, "result", "error", "tries"])

    return grid.mapInPandas(run, schema)


#: Parts of a pass; what a killed run has to do again is a part at most.
PARTS = 4


def ledger(spark: SparkSession, path: str, grid: DataFrame) -> DataFrame:
    """Results so far at a path: the grid's columns, result, error, pass; none where nothing was written."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{fields}, result string, error string, pass int")
    return spark.read.schema(f"{fields}, result string, error string, pass int").parquet(path)


def run_passes(grid: DataFrame, keys: list[str], task: Callable[[dict], str], path: str, passes: int = 2, parts: int = PARTS) -> DataFrame:
    """Runs a task per row of a grid (keys tell rows apart, without nulls) with a table of results at path as its
    ledger: grid columns, result, error, tries. The first pass takes every row, the next ones, after the whole
    pass before, rows that failed. A pass is written in parts, each at once or not at all, and rows that the
    ledger has are not run again: a run that was stopped goes on where it was, with another call."""
    spark, names = grid.sparkSession, grid.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema) + ", result string, error string"

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append({**row, "result": task(dict(row)), "error": None})
                except Exception as e:  # noqa: BLE001 - a task may fail in any way, and that is its result
                    out.append({**row, "result": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*names, "result", "error"])

    for k in range(1, passes + 1):
        for part in range(parts):
            seen = ledger(spark, path, grid)
            todo = grid.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == part)
            if k > 1:
                todo = todo.join(seen.where((F.col("pass") == k - 1) & F.col("error").isNotNull()).select(*keys), keys, "left_semi")
            todo = todo.join(seen.where(F.col("pass") == k).select(*keys), keys, "left_anti").select(*names)
            if not todo.isEmpty():
                todo.mapInPandas(once, schema).withColumn("pass", F.lit(k)).write.mode("append").parquet(path)
    last = ledger(spark, path, grid).groupBy(*names).agg(F.max_by(F.struct("result", "error"), "pass").alias("r"), F.max("pass").alias("tries"))
    return last.select(*names, "r.result", "r.error", "tries")
