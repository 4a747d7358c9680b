"""Writers of transcript formats; each formats rows to lines, so a distributed write follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import clean_text, minutes_seconds


def decimal_seconds(us: Column, digits: int = 3) -> Column:
    """Microseconds as seconds with a fixed number of digits, cut exactly (no binary rounding)."""
    unit = 10 ** (6 - digits)
    whole = F.floor((us + unit // 2) / unit).cast("long")
    return F.format_string(f"%d.%0{digits}d", F.floor(whole / 10**digits), whole % 10**digits)


def rttm_lines(segments: DataFrame) -> DataFrame:
    start, length = decimal_seconds(F.col("start_us")), decimal_seconds(F.col("end_us") - F.col("start_us"))
    return segments.select("file_id", "start_us", F.format_string("SPEAKER %s 1 %s %s <NA> <NA> %s <NA> <NA>", "file_id", start, length, "speaker").alias("value"))


def stm_lines(lines: DataFrame, label: str = "") -> DataFrame:
    """With a label, readers keep every word; without one a strict reader loses the first."""
    head = F.format_string("%s 1 %s %s %s", "file_id", "speaker", decimal_seconds(F.col("start_us")), decimal_seconds(F.col("end_us")))
    parts = [head, F.lit(label), clean_text(F.col("text"))] if label else [head, F.upper(clean_text(F.col("text")))]
    return lines.select("file_id", "start_us", F.concat_ws(" ", *parts).alias("value"))


def ctm_lines(words: DataFrame) -> DataFrame:
    start, length = decimal_seconds(F.col("word_start_us"), 2), decimal_seconds(F.col("word_end_us") - F.col("word_start_us"), 2)
    return words.select("file_id", F.col("word_start_us").alias("start_us"), F.format_string("%s 1 %s %s %s", "file_id", start, length, F.upper("word")).alias("value"))


def word_lines(words: DataFrame, *carried: str) -> DataFrame:
    """start end speaker [OVERLAP] word, times to the millisecond; overlapped is a flag column."""
    tag = F.when(F.col("overlapped"), F.lit("[OVERLAP]"))
    value = F.concat_ws(" ", decimal_seconds(F.col("word_start_us")), decimal_seconds(F.col("word_end_us")), "speaker", tag, "word")
    return words.select("file_id", F.col("word_start_us").alias("start_us"), *carried, value.alias("value"))


def plain_transcript(lines: DataFrame, key: str, name: str = "transcript") -> DataFrame:
    """[mm:ss] speaker: text lines in order, one text per recording."""
    said = F.concat(F.lit("["), minutes_seconds(F.col("start_us") / 1_000_000), F.lit("] "), F.col("speaker"), F.lit(": "), clean_text(F.col("text")))
    rows = lines.select(key, F.struct("start_us", said.alias("said")).alias("r"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["said"]), "\n").alias(name))


def prompt_transcript(lines: DataFrame, key: str, name: str = "transcript") -> DataFrame:
    """[start-end] speaker: text lines in order, one text per recording, for a prompt."""
    said = F.concat(F.lit("["), decimal_seconds(F.col("start_us")), F.lit("-"), decimal_seconds(F.col("end_us")), F.lit("] "), F.coalesce("speaker", F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = lines.select(key, F.struct("start_us", "end_us", said.alias("said")).alias("r"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["said"]), "\n").alias(name))


def change_point_stm(words: DataFrame, segments: DataFrame, label: str = "<o,f0,unk>") -> DataFrame:
    """STM lines of the words of each speaker between change points of the segments."""
    from turnlake.operators.intervals import change_point_lines

    lines = change_point_lines(words, segments).withColumnsRenamed({"t0": "start_us", "t1": "end_us"})
    return stm_lines(lines, label)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files, one folder per recording, in start order."""
    lines.repartition("file_id").sortWithinPartitions("file_id", "start_us").select("file_id", "value").write.partitionBy("file_id").text(path)


def write_jsonl(rows: DataFrame, path: str, by: list[str] | None = None, compression: str = "none") -> None:
    (rows.write.partitionBy(*by) if by else rows.write).json(path, compression=compression)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_manifests(samples: DataFrame, path: str, compression: str = "none") -> None:
    """Samples by stage and split."""
    samples.write.partitionBy("stage", "split").json(path, compression=compression)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    row.coalesce(1).write.json(path)


def write_bundle(path: str, segments: DataFrame, lines: DataFrame, words: DataFrame, meta: DataFrame, label: str = "<o,f0,unk>") -> None:
    """All texts of recordings below a folder: rttm, stm, ctm and words by recording, metadata as JSON."""
    write_lines(rttm_lines(segments), f"{path}/rttm")
    write_lines(stm_lines(lines, label), f"{path}/stm")
    write_lines(ctm_lines(words), f"{path}/ctm")
    write_lines(word_lines(words), f"{path}/words")
    meta.write.partitionBy("file_id").json(f"{path}/meta")


def markdown_table(rows: DataFrame) -> str:
    """A report's table of a small frame, all of it: reports are rendered in the driver, so the frame is to be
    an aggregate of a few rows."""
    cells = [rows.columns, ["---"] * len(rows.columns), *([str(v) for v in r] for r in rows.collect())]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells)
