"""Interval algebra over half-open segments (keys..., speaker, start_us, end_us), times in microseconds.

Islands and sweeps are window passes that share one shuffle by key (a recording). Given slice_us, a window is a
slice of a recording's time instead, and the latest end, the active count and the next start are carried from
slice to slice, so that a recording may be larger than a task; results are the same. Rasters and slides explode
within a row. Empty inputs give empty results; null bounds drop out in filters on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.joins import range_join, right_side
from turnlake.operators.shared import carried, numbered

KEY = ("file_id",)


def overlap_len(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Length of the intersection, 0 if none."""
    return F.greatest(F.lit(0), F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0))).cast("long")


def hull_iou(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Intersection over the hull of both; 0 for an empty hull."""
    hull = F.greatest(F.col(a1), F.col(b1)) - F.least(F.col(a0), F.col(b0))
    return F.when(hull > 0, overlap_len(a0, a1, b0, b1) / hull).otherwise(F.lit(0.0))


def intersects_closed(a0: str, a1: str, b0: str, b1: str) -> Column:
    return ~((F.col(a1) < F.col(b0)) | (F.col(b1) < F.col(a0)))


def _slices(slice_us: int) -> Column:
    return F.floor(F.col("start_us") / F.lit(slice_us))


def islands(segments: DataFrame, keys: tuple[str, ...] = KEY, gap_us: int = 0, slice_us: int | None = None) -> DataFrame:
    """Union of segments per key; a gap of up to gap_us (inclusive) is bridged."""
    if slice_us is None:
        order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
        ended = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = F.when(ended.isNull() | (F.col("start_us") > ended + gap_us), 1).otherwise(0)
        numbered_rows = segments.withColumn("_open", opened).withColumn("_island", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ended = carried(segments, list(keys), _slices(slice_us), F.col("end_us"), F.max, "_ended", ["start_us", "end_us"])
        opened = ended.withColumn("_open", F.when(F.col("_ended").isNull() | (F.col("start_us") > F.col("_ended") + gap_us), F.col("start_us")))
        # An island is named by its first start; of equal segments the one that opens it comes first.
        before = carried(opened, list(keys), _slices(slice_us), F.col("_open"), F.max, "_before", ["start_us", "end_us", F.col("_open").isNull()])
        numbered_rows = before.withColumn("_island", F.coalesce("_open", "_before"))
    return numbered_rows.groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_segments")).drop("_island")


def steps(segments: DataFrame, keys: tuple[str, ...] = KEY, slice_us: int | None = None) -> DataFrame:
    """Elementary intervals between change points with the number of active segments."""
    marks = segments.select(*keys, F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    summed = marks.groupBy(*keys, F.col("m.t").alias("start_us")).agg(F.sum("m.d").alias("d"))
    if slice_us is None:
        order = Window.partitionBy(*keys).orderBy("start_us")
        active = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
        out = summed.withColumn("active", active).withColumn("end_us", F.lead("start_us").over(order))
    else:
        before = carried(summed, list(keys), _slices(slice_us), F.col("d"), F.sum, "_active", ["start_us"])
        after = carried(before, list(keys), _slices(slice_us), F.col("start_us"), F.min, "end_us", [F.desc("start_us")], last_first=True)
        out = after.withColumn("active", F.col("d") + F.coalesce("_active", F.lit(0)))
    return out.where("end_us is not null").select(*keys, "start_us", "end_us", F.col("active").cast("long").alias("active"))


def overlap_regions(segments: DataFrame, keys: tuple[str, ...] = KEY, least: int = 2, slice_us: int | None = None) -> DataFrame:
    """Maximal regions with at least that many active segments."""
    return islands(steps(segments, keys, slice_us).where(F.col("active") >= least), keys, slice_us=slice_us).drop("n_segments")


def by_speaker(segments: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Segments with each speaker's own overlaps merged."""
    return islands(segments, (*keys, "speaker")).drop("n_segments")


def time_profile(segments: DataFrame, keys: tuple[str, ...] = KEY, slice_us: int | None = None) -> DataFrame:
    """Silence (inside the recording's span), single and overlap time, and most active at once."""
    s = steps(segments, keys, slice_us)
    length = F.col("end_us") - F.col("start_us")
    part = lambda c: F.sum(F.when(c, length).otherwise(0)).alias
    return s.groupBy(*keys).agg(part(F.col("active") == 0)("silence_us"), part(F.col("active") == 1)("single_us"), part(F.col("active") >= 2)("overlap_us"), F.max("active").alias("max_active"))


def overlap_starts(segments: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """How often the active count goes from 1 to 2, starts before ends (touching counts)."""
    marks = segments.select(*keys, F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.col("m.t"), F.desc("m.d"))
    active = F.sum("m.d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("active", active).groupBy(*keys).agg(F.sum(F.when((F.col("active") == 2) & (F.col("m.d") == 1), 1).otherwise(0)).alias("overlap_count"))


def gaps(segments: DataFrame, durations: DataFrame, min_gap_us: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Silent stretches of a recording of known duration (0 to duration_us): at the ends longer than
    min_gap_us, between segments at least as long."""
    joined = islands(segments, keys).drop("n_segments")
    order = Window.partitionBy(*keys).orderBy("start_us")
    between = joined.withColumn("next", F.lead("start_us").over(order)).where(F.col("next") - F.col("end_us") >= min_gap_us).select(*keys, F.col("end_us").alias("start_us"), F.col("next").alias("end_us"))
    ends = joined.groupBy(*keys).agg(F.min("start_us").alias("first"), F.max("end_us").alias("last")).join(durations, list(keys))
    head = ends.where(F.col("first") > min_gap_us).select(*keys, F.lit(0).cast("long").alias("start_us"), F.col("first").alias("end_us"))
    tail = ends.where(F.col("duration_us") - F.col("last") > min_gap_us).select(*keys, F.col("last").alias("start_us"), F.col("duration_us").alias("end_us"))
    return head.unionByName(between).unionByName(tail)


def raster_overlap(segments: DataFrame, frame_us: int = 10_000, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Overlap time on a raster of truncated frames: a segment on the raster is one from its first frame
    to behind its last, so no frame becomes a row. Recordings without a frame drop out."""
    framed = segments.select(*keys, F.expr(f"start_us div {frame_us}").alias("start_us"), F.expr(f"end_us div {frame_us}").alias("end_us")).where("end_us > start_us")
    length = F.when(F.col("active") >= 2, F.col("end_us") - F.col("start_us")).otherwise(0)
    return steps(framed, keys).groupBy(*keys).agg((F.sum(length) * frame_us).alias("overlap_us"))


def frame_runs(segments: DataFrame, max_speakers: int, frame_us: int = 20_000, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Runs [start_us, end_us) of active frames, in frames, per speaker index on a rounding raster; of the
    speakers that start first."""
    first = segments.groupBy(*keys, "speaker").agg(F.min("start_us").alias("first"))
    ranked = first.withColumn("speaker_index", F.row_number().over(Window.partitionBy(*keys).orderBy("first", "speaker")) - 1).where(F.col("speaker_index") < max_speakers)
    kept = segments.join(ranked.select(*keys, "speaker", "speaker_index"), [*keys, "speaker"])
    framed = kept.select(*keys, "speaker_index", F.expr(f"(start_us + {frame_us // 2}) div {frame_us}").alias("start_us"), F.expr(f"(end_us + {frame_us // 2}) div {frame_us}").alias("end_us"))
    return islands(framed.where("end_us > start_us"), (*keys, "speaker_index")).drop("n_segments")


def frame_activity(segments: DataFrame, max_speakers: int, frame_us: int = 20_000, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(frame, speaker index) pairs of frame_runs, one row a frame; no frame comes twice."""
    runs = frame_runs(segments, max_speakers, frame_us, keys)
    return runs.select(*keys, F.explode(F.sequence("start_us", F.col("end_us") - 1)).alias("frame"), "speaker_index")


def clip(segments: DataFrame, duration: Column, tail_us: int = 1000) -> DataFrame:
    """Drop segments that start within tail_us of the end, cut the others there."""
    return segments.where(F.col("start_us") < duration - tail_us).withColumn("end_us", F.least(F.col("end_us"), duration))


def clip_both(segments: DataFrame, duration: Column) -> DataFrame:
    """Cut to [0, duration] and drop what is empty then."""
    cut = segments.withColumn("start_us", F.greatest(F.lit(0).cast("long"), "start_us")).withColumn("end_us", F.least(F.col("end_us"), duration))
    return cut.where("end_us > start_us")


def pad(before_us: int, after_us: int, duration: Column) -> list[Column]:
    return [F.greatest(F.lit(0).cast("long"), F.col("start_us") - before_us).alias("start_us"), F.least(duration, F.col("end_us") + after_us).alias("end_us")]


def trim(trim_us: int, slack_us: int = 100_000) -> list[Column]:
    """Cut both ends of segments longer than twice the trim and the slack."""
    long = F.col("end_us") - F.col("start_us") > 2 * trim_us + slack_us
    return [F.when(long, F.col("start_us") + trim_us).otherwise(F.col("start_us")).alias("start_us"), F.when(long, F.col("end_us") - trim_us).otherwise(F.col("end_us")).alias("end_us")]


def shift(by_start: int, by_end: int) -> list[Column]:
    """Move bounds; a start is 0 at least, an end its start at least."""
    start = F.greatest(F.lit(0).cast("long"), F.col("start_us") + by_start)
    return [start.alias("start_us"), F.greatest(start, F.col("end_us") + by_end).alias("end_us")]


def split_long(segments: DataFrame, most_us: int) -> DataFrame:
    """Equal parts of segments longer than most_us (bounds by integer division); adds part, parts."""
    n = F.expr(f"cast(greatest(1, (end_us - start_us + {most_us - 1}) div {most_us}) as int)")
    cut = segments.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = F.expr("start_us + (end_us - start_us) * part div parts")
    b = F.expr("start_us + (end_us - start_us) * (part + 1) div parts")
    return cut.withColumn("_a", a).withColumn("_b", b).withColumn("start_us", F.col("_a")).withColumn("end_us", F.col("_b")).drop("_a", "_b")


def split_long_text(segments: DataFrame, most_us: int) -> DataFrame:
    """split_long for segments with text: each part takes max(1, words // parts) words, the last the
    rest; a part without words keeps the whole text."""
    cut = split_long(segments.withColumn("words", F.split(F.trim("text"), r"\s+")), most_us)
    step = F.expr("greatest(1, size(words) div parts)")
    taken = F.when(F.col("parts") == 1, F.col("words")).when(F.col("part") == F.col("parts") - 1, F.expr("slice(words, cast(part * _step as int) + 1, size(words))")).otherwise(F.expr("slice(words, cast(part * _step as int) + 1, cast(_step as int))"))
    out = cut.withColumn("_step", step).withColumn("_t", F.array_join(taken, " "))
    return out.withColumn("text", F.when(F.col("_t") == "", F.col("text")).otherwise(F.col("_t"))).drop("_step", "_t", "words")


def sliding_windows(recordings: DataFrame, chunk_us: int, stride_us: int) -> DataFrame:
    """Windows of each recording (duration_us); the last is kept if half of it is inside."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("duration_us") - chunk_us // 2), F.lit(stride_us).cast("long"))
    out = recordings.where("duration_us > 0").withColumn("start_us", F.explode(starts)).withColumn("end_us", F.least(F.col("duration_us"), F.col("start_us") + chunk_us))
    return out.where((F.col("end_us") - F.col("start_us") >= chunk_us // 2) | (F.col("start_us") == 0))


def adjacent_gaps(segments: DataFrame, longer_us: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Neighbours in start order whose gap is longer."""
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    return segments.withColumn("gap_us", F.lead("start_us").over(order) - F.col("end_us")).where(F.col("gap_us") > longer_us)


def reindex(segments: DataFrame, keys: tuple[str, ...] = KEY, tie: str = "seg_id") -> DataFrame:
    """Adds idx, the running number of a segment from 1; a speaker's segments may be more than a task holds."""
    return numbered(segments, list(keys), ["start_us", "end_us", tie], "idx").withColumn("idx", (F.col("idx") + 1).cast("int"))


def merge_rows(segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key: first start, the end of the last by start, texts in order."""
    return segments.groupBy(*keys).agg(F.min("start_us").alias("start_us"), F.max_by("end_us", F.struct("start_us", "end_us")).alias("end_us"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_us", "end_us", "text"))), lambda x: x["text"]), " ").alias("text"))


def slots_to_events(slots: DataFrame) -> DataFrame:
    """One row per speaker of a slot; slots without speakers (silence) give none."""
    return slots.withColumn("speaker", F.explode("speakers")).drop("speakers")


def project_words(slots: DataFrame, words: str = "words") -> DataFrame:
    """Equal shares of a slot for its words, in order: (word, word_start_us, word_end_us)."""
    out = slots.where(F.size(words) > 0).select("*", F.posexplode(words).alias("pos", "word")).withColumn("_n", F.size(words))
    return out.withColumn("word_start_us", F.expr("start_us + (end_us - start_us) * pos div _n")).withColumn("word_end_us", F.expr("start_us + (end_us - start_us) * (pos + 1) div _n")).drop("_n")


def project_aligned(slots: DataFrame, alignments: DataFrame, on: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Word times of a slot from an alignment of its source (on; words: array of word, start, end in
    seconds): in proportion to the source's length, inside the slot. Sources without an alignment, or
    with an empty one, take the slot's own words in equal shares."""
    joined = slots.join(alignments.select(on, F.col("words").alias("_aligned")), on, "left")
    found = joined.where(F.size("_aligned") > 0).select("*", F.posexplode("_aligned").alias("pos", "_w"))
    length = F.expr("element_at(_aligned, -1).end")
    at = lambda part: F.when(length > 0, part / length)
    start = F.floor(F.col("start_us") + F.coalesce(at(F.col("_w.start")), F.lit(0.0)) * (F.col("end_us") - F.col("start_us")) + 0.5).cast("long")
    end = F.floor(F.col("start_us") + F.coalesce(at(F.col("_w.end")), F.lit(1.0)) * (F.col("end_us") - F.col("start_us")) + 0.5).cast("long")
    inside = found.withColumn("word", F.col("_w.word")).withColumn("word_start_us", F.greatest("start_us", F.least(start, F.col("end_us"))))
    inside = inside.withColumn("word_end_us", F.greatest("word_start_us", F.least(end, F.col("end_us"))))
    columns = [*slots.columns, "pos", "word", "word_start_us", "word_end_us"]
    return inside.select(*columns).unionByName(project_words(joined.where("coalesce(size(_aligned), 0) <= 0").drop("_aligned")).select(*columns))


def overlapped_words(words: DataFrame, segments: DataFrame, longer_us: int = 50_000, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Adds overlapped: another speaker's segment covers more than longer_us of the word."""
    when = [*keys, "speaker", "word_start_us", "word_end_us"]
    times = words.select(*when, F.col("word_start_us").alias("start_us"), F.col("word_end_us").alias("end_us")).distinct()
    hits = range_join(times, right_side(segments.select(*keys, "speaker", "start_us", "end_us"), list(keys)), list(keys)).where("speaker <> r_speaker")
    long = hits.where(F.expr(f"least(end_us, r_end_us) - greatest(start_us, r_start_us) > {longer_us}")).select(*when).distinct().withColumn("_hit", F.lit(True))
    return words.join(long, when, "left").withColumn("overlapped", F.coalesce("_hit", F.lit(False))).drop("_hit")


def change_point_lines(words: DataFrame, segments: DataFrame, keys: tuple[str, ...] = KEY, least_us: int = 10_000) -> DataFrame:
    """Per elementary interval of at least least_us and speaker: the words whose middle lies in it. A word's
    middle is an interval of one microsecond, so words meet cuts by time bucket."""
    cuts = steps(segments, keys).where((F.col("active") > 0) & (F.col("end_us") - F.col("start_us") >= least_us)).select(*keys, F.col("start_us").alias("r_start_us"), F.col("end_us").alias("r_end_us"))
    middle = F.expr("(word_start_us + word_end_us) div 2")
    held = range_join(words.withColumn("start_us", middle).withColumn("end_us", middle + 1), cuts, list(keys))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_start_us", "seg_id", "pos", "word"))), lambda x: x["word"]), " ")
    return held.groupBy(*keys, F.col("r_start_us").alias("t0"), F.col("r_end_us").alias("t1"), "speaker").agg(text.alias("text"))
