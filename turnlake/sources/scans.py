"""Scans of recording trees into parents and samples, and listings of sessions, cases and runs.

A split is a folder of recordings: data*/mixture.wav, data*/labeled/ with a transcript and mixture.rttm, and
metadata.txt beside them. read_split() reads one; the functions after it take frames, so tables, streams or
other layouts can be scanned alike. Recordings without audio or without any transcript line drop out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import scalars as S
from turnlake.functions import text as X
from turnlake.operators import dedup as D
from turnlake.operators import folds as O
from turnlake.operators import intervals as I
from turnlake.operators import joins as J
from turnlake.operators.shared import durable
from turnlake.sources import readers as R

#: Names of a recording's files, transcripts in the order in which they count.
AUDIO, SEGMENTS = "mixture.wav", "mixture.rttm"
TRANSCRIPTS = ("transcript_dataset.jsonl", "transcript.jsonl", "mixture.stm")
METADATA = "metadata.txt"
#: Margins of a sample, and the gap that speech regions bridge.
PAD_LEFT_US, PAD_RIGHT_US = 100_000, 200_000
REGION_GAP_US = 150_000
#: The bucket that a source type always has.
SOURCE_BUCKETS = {"dubbed": "silver_dubbed", "robustness": "robustness"}
REUSED_SOURCE = "vivos"
#: Sources that make up a stage's base hours, and stage two's besides; the least overlap that
#: validation allows.
BASE_SOURCES, SECOND_SOURCES = ("self_train", "dubbed_train"), ("robustness_train",)
RATIO_SOURCE, VALIDATION_SOURCE = "vivos_train", "self_val"
VALIDATION_OVERLAP = 0.35


def wav_micros(spark_files: DataFrame, path: str = "path") -> DataFrame:
    """Adds duration_us of RIFF audio, from the heads of the files alone; null for what is none."""
    schema = f"{path} string, duration_us long"

    def one(uri: str) -> int | None:
        store, at = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + ("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri))
        with store.open_input_file(at) as f:
            head = f.read(12)
            if head[:4] != b"RIFF" or head[8:] != b"WAVE":
                return None
            rate = None
            while len(head := f.read(8)) == 8:
                kind, size = struct.unpack("<4sI", head)
                if kind == b"fmt ":
                    body = f.read(size + size % 2)
                    rate = struct.unpack_from("<I", body, 8)[0] if size >= 12 else None
                elif kind == b"data":
                    return size * 1_000_000 // rate if rate else None
                else:
                    f.seek(f.tell() + size + size % 2)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([one(p) for p in paths], pa.int64())], names=[path, "duration_us"])

    found = spark_files.select(path).distinct().mapInArrow(run, schema)
    return spark_files.join(found, path, "left")


@dataclass
class Split:
    """Frames of one split, by file_id (the recording's folder)."""

    recordings: DataFrame  # file_id, audio_path, duration_us
    text: DataFrame  # file_id, start_us, end_us, speaker, text
    turns: DataFrame  # file_id, start_us, end_us, speaker
    metadata: DataFrame  # name, class_name, speakers, episode
    units: DataFrame | None = None  # file_id, unit


def _lines(spark: SparkSession, root: str, name: str, level: int = -3) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root).withColumn("path", F.input_file_name())
    return lines.withColumn("file_id", F.element_at(F.split("path", "/"), level))


def read_split(spark: SparkSession, root: str) -> Split:
    """All frames of a split's folder; a recording's name is its folder's, whatever its files say."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", AUDIO).load(root).select("path")
    audio = wav_micros(found).select(F.element_at(F.split("path", "/"), -2).alias("file_id"), F.col("path").alias("audio_path"), "duration_us")
    columns = ["file_id", "start_us", "end_us", "speaker", "text"]
    sources = []
    for name in TRANSCRIPTS:
        lines = _lines(spark, root, name)
        sources.append((R.transcript_json(lines) if name.endswith(".jsonl") else R.stm(lines, key="file_id")).select(*columns))
    turns = R.rttm(_lines(spark, root, SEGMENTS), key="file_id").select(*columns[:4])
    meta = _lines(spark, root, METADATA, -2).select("value", F.monotonically_increasing_id().alias("line_no"))
    units = _lines(spark, root, "transcript*.jsonl")
    unit = S.first_filled("r", ["base_utt_id", "utt_id", "source_utt_id", "utt"])
    units = units.select("file_id", F.from_json("value", "map<string,string>").alias("r")).select("file_id", unit.alias("unit")).where("unit is not null").distinct()
    return Split(audio.where("duration_us is not null"), R.first_source(*sources), turns, R.class_table(meta), units)


def parents(split: Split, split_name: str, source_type: str, bucket: str | None = None, by_overlap: bool = False) -> DataFrame:
    """One row per recording with text: ids, paths, class, group, bucket, episode, duration. by_overlap:
    metadata's second column is a level of overlap, which names the group of one common class."""
    told = split.recordings.join(split.text.select("file_id").distinct(), "file_id", "left_semi")
    known = told.join(split.metadata.select(F.col("name").alias("file_id"), "class_name", "episode"), "file_id", "left")
    name = X.normalize_name(F.coalesce("class_name", "file_id"))
    fixed = bucket or (REUSED_SOURCE if by_overlap else SOURCE_BUCKETS.get(source_type))
    return known.select(
        X.stable_id(F.lit(source_type), F.lit(split_name), F.col("file_id"), F.col("audio_path")).alias("parent_id"),
        "file_id",
        "audio_path",
        F.lit(split_name).alias("split_name"),
        F.lit(source_type).alias("source_type"),
        (F.lit(fixed) if fixed else S.class_bucket(name)).alias("bucket"),
        (F.lit(REUSED_SOURCE) if by_overlap else name).alias("class_name"),
        name.alias("group_name"),
        F.coalesce("episode", F.lit("")).alias("episode"),
        "duration_us",
    )


def samples(split: Split, of: DataFrame, spec: O.ChunkSpec = O.ChunkSpec()) -> DataFrame:
    """Chunks of the parents' text: lines cut to speech, joined and split by the chunk rules, padded inside
    the recording, without near copies, with the share of overlapped speech."""
    key = ["file_id"]
    told = split.text.join(of.select("file_id"), "file_id", "left_semi")
    cut = J.clamp_to_region(told.select("file_id", "start_us", "end_us").distinct(), I.islands(split.turns, gap_us=REGION_GAP_US).drop("n_segments"), key, ["file_id", "start_us", "end_us"])
    valid = F.col("c_end_us") > F.col("c_start_us")
    spans = cut.select("file_id", "start_us", "end_us", F.when(valid, F.col("c_start_us")).otherwise(F.col("start_us")).alias("a"), F.when(valid, F.col("c_end_us")).otherwise(F.col("end_us")).alias("b"))
    lines = told.join(spans, ["file_id", "start_us", "end_us"]).drop("start_us", "end_us").withColumnsRenamed({"a": "start_us", "b": "end_us"})
    chunked = O.chunks(lines, split.turns, spec).join(of.select("file_id", "duration_us"), "file_id")
    padded = chunked.select("file_id", F.col("n").alias("seg_id"), "speaker", "text", *I.pad(PAD_LEFT_US, PAD_RIGHT_US, F.col("duration_us"))).where("end_us > start_us")
    kept = O.per_recording(padded, O.drop_near_copies)
    rated = J.overlap_ratio(kept, I.overlap_regions(split.turns), key, ["file_id", "n"]).join(of, "file_id")
    said = X.clean_text(F.col("text"))
    centis = lambda c: F.expr(f"cast(({c} + 5000) div 10000 as string)")
    made = rated.select(X.stable_id(F.col("parent_id"), centis("start_us"), centis("end_us"), said).alias("sample_id"), "parent_id", "file_id", "split_name", "source_type", "bucket", "class_name", "group_name", "start_us", "end_us", "speaker", "text", "overlap_ratio")
    return made.dropDuplicates(["sample_id"])


#: Fixed values of the scan without text: speakers that stand for nobody, the longest and the shortest part.
UNKNOWN_SPEAKERS = ("unknown", "spk_unknown", "")
PART_MOST_US, PART_LEAST_US = 29_000_000, 500_000


def segment_samples(turns: DataFrame, recordings: DataFrame, metadata: DataFrame, unknown: tuple[str, ...] = UNKNOWN_SPEAKERS) -> DataFrame:
    """Samples of turns (file_id, seg_id, speaker, start_us, end_us) without reference text: known speakers' turns,
    split, without short parts, padded inside the recording (file_id, duration_us), with the share of
    overlapped speech and the class of the metadata (name, class_name) or the recording's own name."""
    cut = I.split_long(turns.where(~F.lower("speaker").isin(*unknown)), PART_MOST_US).where(F.col("end_us") - F.col("start_us") >= PART_LEAST_US)
    inside = cut.join(recordings.select("file_id", "duration_us"), "file_id")
    padded = inside.select("file_id", "seg_id", "part", "speaker", *I.pad(PAD_LEFT_US, PAD_RIGHT_US, F.col("duration_us"))).withColumn("_part", F.concat_ws("|", "file_id", "seg_id", "part"))
    rated = J.overlap_ratio(padded, I.overlap_regions(turns), ["file_id"], "_part").drop("_part", "covered_us")
    named = rated.join(metadata.select(F.col("name").alias("file_id"), "class_name"), "file_id", "left")
    return named.withColumn("class_name", X.normalize_name(F.coalesce("class_name", "file_id")))


def limit_units(rows: DataFrame, units: DataFrame, most: int = 2) -> DataFrame:
    """Samples in order of parent and start, each base unit of a recording (file_id, unit) in most kept ones;
    samples of recordings without units stay, sources are apart. The rows are stored once; ids, order and
    units alone decide (dedup.capped_rows)."""
    stored = durable(rows)
    listed = units.groupBy("file_id").agg(F.collect_set("unit").alias("units"))
    narrow = stored.select("sample_id", F.col("source_type").alias("group"), "parent_id", "start_us", "file_id").join(listed, "file_id", "left").drop("file_id")
    stay = D.capped_rows(narrow, "sample_id", ["parent_id", "start_us"], most)
    return stored.join(stay.withColumnRenamed("group", "source_type"), ["sample_id", "source_type"], "left_semi")


def scan(split: Split, split_name: str, source_type: str, bucket: str | None = None, by_overlap: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents and samples of one split."""
    of = parents(split, split_name, source_type, bucket, by_overlap)
    made = samples(split, of)
    return of, limit_units(made, split.units) if source_type == REUSED_SOURCE and split.units is not None else made


def scan_all(splits: dict[str, tuple[Split, str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Parents and samples of several splits (name: split, split name, source type, by overlap), under
    source_partition."""
    out: list = [None, None]
    for name, (split, split_name, source_type, by_overlap) in splits.items():
        for k, frame in enumerate(scan(split, split_name, source_type, by_overlap=by_overlap)):
            tagged = frame.withColumn("source_partition", F.lit(name))
            out[k] = tagged if out[k] is None else out[k].unionByName(tagged)
    return out[0], out[1]


def stage_manifest(all_parents: DataFrame, all_samples: DataFrame, allowed_overlap: float, ratio: float, seed: int, second: bool = False, unit: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Samples of a stage with part ('train' or 'val'). Training takes every recording of the base sources, and
    of RATIO_SOURCE recordings in hash order until they last ratio times the base; validation the samples
    of VALIDATION_SOURCE. Samples over the overlap allowed drop out, repeats and units used twice too."""
    from turnlake.operators.sampling import until_target

    base = [*BASE_SOURCES, *(SECOND_SOURCES if second else ())]
    inside = all_parents.where(F.col("source_partition").isin(base))
    target = inside.agg((F.coalesce(F.sum("duration_us"), F.lit(0)) * ratio).alias("_target"))
    # One row of hours.
    offered = all_parents.where(F.col("source_partition") == RATIO_SOURCE).join(F.broadcast(target))
    chosen = inside.select("parent_id").unionByName(until_target(offered, ["source_partition"], "parent_id", "duration_us", F.col("_target"), seed + 13).select("parent_id"))
    train = all_samples.join(chosen, "parent_id", "left_semi").where((F.col("source_partition") != VALIDATION_SOURCE) & (F.col("overlap_ratio") <= allowed_overlap)).withColumn("part", F.lit("train"))
    val = all_samples.where((F.col("source_partition") == VALIDATION_SOURCE) & (F.col("overlap_ratio") <= max(VALIDATION_OVERLAP, allowed_overlap))).withColumn("part", F.lit("val"))
    whole = train.unionByName(val).dropDuplicates(["part", "sample_id"])
    if unit is None:
        return whole
    reused = (F.col("part") == "train") & (F.col("source_partition") == RATIO_SOURCE)
    limited = whole.withColumn("_unit", F.when(reused, F.col(unit)))
    return D.limit_reuse(limited, "_unit", order or ["sample_id"]).drop("_unit")


def scan_summary(all_parents: DataFrame, all_samples: DataFrame) -> DataFrame:
    """Recordings, hours and samples per source partition."""
    counted = all_samples.groupBy("source_partition").agg(F.count("*").alias("samples"))
    told = all_parents.groupBy("source_partition").agg(F.count("*").alias("parents"), F.round(F.sum("duration_us") / 3.6e9, 3).alias("hours"))
    return told.join(counted, "source_partition", "left").fillna({"samples": 0})


def export_manifests(path: str, all_parents: DataFrame, all_samples: DataFrame, stages: dict[str, DataFrame]) -> None:
    """All samples, a summary per source partition, and the stages' manifests by stage and split. The rows of
    samples repeat their names and are several times as large as the tables they come from, so they are gzipped."""
    from turnlake.sources import sinks as K

    K.write_jsonl(all_samples, f"{path}/unified_manifest", compression="gzip")
    K.write_jsonl(scan_summary(all_parents, all_samples), f"{path}/scan_summary")
    whole = None
    for name, rows in stages.items():
        tagged = rows.withColumn("stage", F.lit(name)).withColumnRenamed("part", "split")
        whole = tagged if whole is None else whole.unionByName(tagged)
    K.write_manifests(whole, f"{path}/stages", compression="gzip")


def sessions(recordings: DataFrame, turns: DataFrame, overlaps: DataFrame, source: str, max_speakers: int = 4, fixed_tier: bool = False) -> DataFrame:
    """Sessions of a folder (recordings: file_id, wav_path, rttm_path, duration_us, enrollment_dir) with both
    files: speakers by metadata (overlaps: name, overlap, n_speakers, episode), else as the turns count
    them; how many are loaded; the source's tier by overlap, or the source itself for self-labelled ones."""
    counted = turns.groupBy("file_id").agg(F.countDistinct("speaker").cast("int").alias("_counted"))
    both = recordings.where("wav_path is not null and rttm_path is not null").join(counted, "file_id", "left")
    known = both.join(overlaps.select(F.col("name").alias("file_id"), "overlap", F.col("n_speakers").alias("_told"), "episode"), "file_id", "left").fillna({"overlap": 0, "episode": 0})
    n = F.coalesce("_told", "_counted", F.lit(0))
    tier = F.lit(source) if source == "self_labeled" else F.lit(S.TIERS[0][2]) if fixed_tier else S.overlap_tier(F.col("overlap"))
    named = known.select("file_id", "wav_path", "rttm_path", "duration_us", tier.alias("source"), n.alias("n_speakers"), S.capped(n, max_speakers).alias("load_speakers"), "overlap", "episode", F.coalesce("enrollment_dir", F.lit("")).alias("enrollment_dir"))
    return named.withColumn("folder", S.speaker_folder(F.col("n_speakers")))


#: Names under which metadata records keep a class, an overlap and a number of speakers, the
#: group of a split without classes, and the number of speakers where nothing tells it.
CLASS_NAMES = ["class", "class_name", "category", "label", "scene", "noise", "condition", "type", "group", "domain", "index"]
OVERLAP_NAMES = ["overlap_count", "overlap", "overlap_pct", "overlap_percent", "overlap_percentage", "ovl", "ovl_count"]
SPEAKER_NAMES = ["n_speakers", "num_speakers", "speaker_count", "spk", "speakers"]
PLAIN_SPLIT, PLAIN_GROUP = "test_data", "vivo"
USUAL_SPEAKERS = 3


def normal_record(record: str) -> list[Column]:
    """class_name, overlap and n_speakers of a metadata record (a map), under any of their names."""
    first = lambda names: S.first_filled(record, names)
    value = lambda names: F.regexp_extract(first(names), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return [first(CLASS_NAMES).alias("class_name"), value(OVERLAP_NAMES).alias("overlap"), F.rint(value(SPEAKER_NAMES)).cast("int").alias("n_speakers")]


def cases(listing: DataFrame, records: DataFrame, turns: DataFrame, split: str) -> DataFrame:
    """Cases of a split in natural order (place): folders with audio and segments (listing: folder, file, and
    enrolled, the number of enrolled speakers). Speakers: by metadata, else enrolled, else of the segments,
    else USUAL_SPEAKERS (zero counts as untold); group by class, or the plain split's."""
    audio = R.files_by_folder(listing, ["mixture.wav", "mixture.flac", "audio.wav", "audio.flac"], "audio")
    marked = listing.groupBy("folder").agg(F.max_by("file", F.col("file").endswith(".rttm").cast("int")).alias("rttm"), F.max("enrolled").alias("enrolled")).where("endswith(rttm, '.rttm')")
    counted = turns.groupBy(F.col("file_id").alias("folder")).agg(F.countDistinct("speaker").cast("int").alias("_turns"), F.count("*").alias("ref_segments"))
    told = records.select(F.col("case_id").alias("folder"), *normal_record("record"))
    joined = audio.join(marked, "folder").join(counted, "folder", "left").join(told, "folder", "left")
    some = lambda c: F.nullif(F.col(c).cast("int"), F.lit(0))
    n = F.coalesce(some("n_speakers"), some("enrolled"), some("_turns"), F.lit(USUAL_SPEAKERS))
    group = F.lit(PLAIN_GROUP) if split == PLAIN_SPLIT else F.coalesce("class_name", F.lit("unknown"))
    out = joined.select(F.lit(split).alias("split"), F.col("folder").alias("case_id"), "audio", "rttm", n.alias("n_speakers"), group.alias("group_name"), "overlap", F.coalesce("ref_segments", F.lit(0)).alias("ref_segments"))
    return out.withColumn("natural", X.natural_key(F.col("case_id")))


def speaker_segments(audio: DataFrame, speakers: list[str] | None = None) -> DataFrame:
    """Audio files by speaker (audio: path, duration_us; the speaker is the folder), of the speakers asked for."""
    named = audio.withColumn("speaker", F.element_at(F.split("path", "/"), -2)).where("duration_us is not null")
    return (named.where(F.col("speaker").isin(speakers)) if speakers else named).select("speaker", "path", "duration_us")


def run_list(files: DataFrame) -> DataFrame:
    """Saved runs (files: run, rel: the path inside the run, modified): what they have, newest change, state."""
    rel = F.col("rel")
    found = files.groupBy("run").agg(
        F.max("modified").alias("updated"),
        F.bool_or(rel.startswith("der/")).alias("has_der"),
        F.bool_or(rel == "asr/asr_results.csv").alias("has_asr"),
        F.bool_or(rel.isin("qwen/qwen_summary.json", "qwen/qwen_summary.md")).alias("has_summary"),
        F.count("*").alias("file_count"),
    )
    return found.withColumn("status", F.when(F.col("has_der") & F.col("has_asr"), "complete").otherwise("partial"))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """run_list of the folders below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"))
    below = F.expr(f"substring_index(path, '{root.rstrip('/').split('://')[-1].removeprefix('file:')}/', -1)")
    return run_list(files.select(F.substring_index(below, "/", 1).alias("run"), F.regexp_replace(below, "^[^/]+/", "").alias("rel"), "modified"))


def segment_manifest(lines: DataFrame, root: str) -> DataFrame:
    """A manifest of transcript lines (file_id, line_no, value as JSON) for a language model: one sample a line
    that is JSON with numeric times, in file order; a missing time is 0, a missing speaker Unknown."""
    r = lines.withColumn("r", F.from_json("value", "map<string,string>")).where("r is not null")
    time = lambda k: F.when(F.map_contains_key("r", F.lit(k)), R.micros(f"r['{k}']")).otherwise(F.lit(0).cast("long"))
    out = r.select("file_id", "line_no", time("start").alias("start_us"), time("end").alias("end_us"), F.coalesce(F.col("r")["speaker"], F.lit("Unknown")).alias("speaker"), F.coalesce(F.col("r")["text"], F.lit("")).alias("text"))
    valid = out.where("start_us is not null and end_us is not null")
    return valid.select(
        F.concat_ws("_", "file_id", F.col("line_no").cast("string")).alias("sample_id"),
        F.col("file_id").alias("parent_id"),
        F.concat(F.lit(f"{root}/"), "file_id", F.lit(f"/{AUDIO}")).alias("audio_path"),
        F.lit("test").alias("split_name"),
        F.lit("custom").alias("source_type"),
        "start_us",
        "end_us",
        F.greatest(F.lit(0).cast("long"), F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "speaker",
        "text",
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON drop out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def normal_reference(lines: DataFrame) -> DataFrame:
    """Reference lines with spoken text in normal form, without those that have no word left."""
    return lines.withColumn("text", X.normalize_spoken(X.nfc("text"))).where("text <> ''")
