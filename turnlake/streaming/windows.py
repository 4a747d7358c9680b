"""Streaming counterparts of the batch interval operators. They extend the batch set: regions by gap
become session windows, sliding windows become windows over event time, both with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speech_sessions(events: DataFrame, time: str, keys: list[str], gap: str = "150 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of events no further apart than gap, per key; events later than late drop out."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def sliding_counts(events: DataFrame, time: str, keys: list[str], size: str = "8 seconds", slide: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Events and their values per sliding window and key."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def progress_lines(lines: DataFrame) -> DataFrame:
    """done and total of PROGRESS:done/total lines of a stream of text."""
    p = r"PROGRESS:(\d+)/(\d+)"
    return lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).cast("long").alias("done"), F.regexp_extract("value", p, 2).cast("long").alias("total"))
