"""Progress of sessions from a stream of their lines: keyed state over micro-batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINE = re.compile(r"^PROGRESS:\s*(\d+)/(\d+)")
#: A stage without lines for so long has timed out.
SILENCE_MS = 10 * 60 * 1000
STATE = "start_us long, at_us long, done long, total long"
OUT = "session string, stage string, done long, total long, elapsed_us long, left_us long, timed_out boolean"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    def row(start: int, at: int, done: int, total: int, out: bool) -> pd.DataFrame:
        # More done than the total tells leaves less than nothing, cut toward zero like SQL's integer division.
        ahead = abs(total - done) * (at - start) // done if done else None
        left = -ahead if done > total else ahead
        return pd.DataFrame({"session": [key[0]], "stage": [key[1]], "done": [done], "total": [total], "elapsed_us": [at - start], "left_us": pd.array([left], "Int64"), "timed_out": [out]})

    if state.hasTimedOut:
        start, at, done, total = state.get
        state.remove()
        yield row(start, at, done, total, True)
        return
    start, at, done, total = state.get if state.exists else (None, None, 0, 0)
    rows = sorted((int(t.value) // 1000, v or "") for f in frames for t, v in zip(f["ts"], f["value"], strict=True))
    last = rows[-1][0]
    for us, value in rows:
        start = us if start is None else min(start, us)
        found = LINE.match(value)
        # A line that is late or comes again tells nothing new.
        if found and (at is None or int(found[1]) > done):
            at, done, total = us, int(found[1]), int(found[2])
    at = start if at is None else at
    state.update((start, at, done, total))
    state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + SILENCE_MS)
    yield row(start, at, done, total, False)


def session_progress(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per session and stage that has news (update mode) of a stream of lines (session, stage, ts, value): how much
    of PROGRESS:done/total is done, since when the stage runs, and the time left at its rate (null before the
    first step); a stage without lines for SILENCE_MS is told once more as timed out. Of a stage's lines, those
    that are not above what is done count for nothing."""
    held = lines.select("session", "stage", "ts", "value").withWatermark("ts", late).groupBy("session", "stage")
    return held.applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_progress(lines: DataFrame, path: str) -> DataFrame:
    """Runs the stream over what there is and returns the latest news of each session and stage; every batch is
    written below path under its number, so that one that runs again replaces itself."""
    from pyspark.sql import functions as F

    query = session_progress(lines).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query.foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/news/batch_{k}")).start().awaitTermination()
    news = lines.sparkSession.read.parquet(f"{path}/news/*")
    last = news.groupBy("session", "stage").agg(F.max_by(F.struct("done", "total", "elapsed_us", "left_us", "timed_out"), "batch").alias("r"))
    return last.select("session", "stage", "r.*")
