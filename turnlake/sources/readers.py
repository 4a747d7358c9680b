"""Readers of transcript and metadata formats. Each parses a frame of lines (value, and file_id where the
format has none), so a path, a stream or a table of lines are read alike; lines that do not fit drop out.
Times become microseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.scalars import first_filled
from turnlake.functions.text import clean_text, vtt_micros

START = ["start", "start_time", "begin"]
END = ["end", "end_time", "finish"]
SPEAKER = ["speaker", "spk", "speaker_id"]
TEXT = ["text", "utterance", "transcript"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the folder they lie in as file_id."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("path", F.input_file_name())
    return lines.withColumn("file_id", F.element_at(F.split("path", "/"), -2))


def micros(seconds: str) -> Column:
    """Microseconds of a decimal number in text, rounded exactly; null for no number."""
    return F.expr(f"cast(floor(try_cast({seconds} as decimal(24, 9)) * 1000000 + 0.5) as bigint)")


def _fields(lines: DataFrame, name: str = "f") -> DataFrame:
    """The fields of each line. They come out of a generator: Catalyst puts plain columns into every filter
    and field that uses them, and each would split the line anew."""
    return lines.select("*", F.explode_outer(F.array(F.split(F.trim("value"), r"\s+"))).alias(name))


def rttm(lines: DataFrame, key: str | None = None) -> DataFrame:
    """SPEAKER lines of 8 fields and more: (file_id, start_us, end_us, speaker). file_id is the line's, or that
    of a column of the lines."""
    f = _fields(lines).where("size(f) >= 8 and get(f, 0) = 'SPEAKER'")
    f = f.select((F.col(key) if key else F.expr("get(f, 1)")).alias("file_id"), micros("get(f, 3)").alias("start_us"), micros("get(f, 4)").alias("_d"), F.expr("get(f, 7)").alias("speaker"))
    return f.where("start_us is not null and _d is not null").select("file_id", "start_us", (F.col("start_us") + F.col("_d")).alias("end_us"), "speaker")


def rttm_events(lines: DataFrame) -> DataFrame:
    return rttm(lines).withColumn("event_type", F.lit("speech"))


def stm(lines: DataFrame, has_label: bool | None = None, key: str | None = None) -> DataFrame:
    """(file_id, speaker, start_us, end_us, text). Text begins at field 7 with a label, at 6 without;
    None tells by the look of field 6 (<...>). has_label=True on lines without loses a word, as a strict
    reader does. Lines without text or with an end not after the start drop out."""
    f = _fields(lines).where("size(f) >= 6 and not startswith(get(f, 0), ';;')")
    labelled = F.expr("get(f, 5) rlike '^<.*>$'") if has_label is None else F.lit(has_label)
    f = f.withColumn("text", F.array_join(F.when(labelled, F.expr("slice(f, 7, size(f))")).otherwise(F.expr("slice(f, 6, size(f))")), " "))
    f = f.withColumn("start_us", micros("get(f, 3)")).withColumn("end_us", micros("get(f, 4)")).where("end_us > start_us and text <> ''")
    return f.select((F.col(key) if key else F.expr("get(f, 0)")).alias("file_id"), F.expr("get(f, 2)").alias("speaker"), "start_us", "end_us", "text")


def transcript_json(lines: DataFrame) -> DataFrame:
    """JSON lines under any of the known names; lines without times or text drop out."""
    r = lines.withColumn("r", F.from_json("value", "map<string,string>")).where("r is not null")
    pick = lambda names: first_filled("r", names)
    r = r.withColumn("_s", pick(START)).withColumn("_e", pick(END)).withColumn("text", clean_text(pick(TEXT)))
    out = r.select("file_id", micros("_s").alias("start_us"), micros("_e").alias("end_us"), pick(SPEAKER).alias("speaker"), "text")
    return out.where("start_us is not null and end_us is not null and text <> ''")


def first_source(*sources: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of the first source, in the order given, that has any for a recording."""
    every = None
    for k, s in enumerate(sources):
        tagged = s.withColumn("_priority", F.lit(k))
        every = tagged if every is None else every.unionByName(tagged)
    best = every.groupBy(key).agg(F.min("_priority").alias("_best"))
    return every.join(best, key).where("_priority = _best").drop("_priority", "_best")


def bracket(lines: DataFrame) -> DataFrame:
    """[1.0s - 2.5s] SPEAKER: text"""
    p = r"^\[\s*([\d.]+)s?\s*-\s*([\d.]+)s?\s*\]\s*([^:]+?)\s*:\s*(.*)$"
    m = lines.where(F.col("value").rlike(p)).withColumn("_s", F.regexp_extract("value", p, 1)).withColumn("_e", F.regexp_extract("value", p, 2))
    return m.select("file_id", micros("_s").alias("start_us"), micros("_e").alias("end_us"), F.regexp_extract("value", p, 3).alias("speaker"), F.regexp_extract("value", p, 4).alias("text"))


def annotator(lines: DataFrame) -> DataFrame:
    """[01.00s - 02.50s] Text: | SPEAKER | text"""
    p = r"^\[\s*([\d.]+)s\s*-\s*([\d.]+)s\s*\]\s*Text:\s*\|?\s*([^|]*?)\s*\|\s*(.*)$"
    m = lines.where(F.col("value").rlike(p)).withColumn("_s", F.regexp_extract("value", p, 1)).withColumn("_e", F.regexp_extract("value", p, 2))
    return m.select("file_id", micros("_s").alias("start_us"), micros("_e").alias("end_us"), F.regexp_extract("value", p, 3).alias("speaker"), F.regexp_extract("value", p, 4).alias("text"))


def webvtt(files: DataFrame) -> DataFrame:
    """Cues of whole files (file_id, value): tags and lines in brackets go, empty cues too."""
    cue = files.select("file_id", F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("cue"))
    p = r"(?s)(\d[\d:]*[.,]\d+)\s*-->\s*(\d[\d:]*[.,]\d+)[^\n]*\n(.*)$"
    m = cue.where(F.col("cue").rlike(p)).withColumn("_s", F.regexp_extract("cue", p, 1)).withColumn("_e", F.regexp_extract("cue", p, 2)).withColumn("_t", F.regexp_extract("cue", p, 3))
    kept = F.filter(F.transform(F.split("_t", "\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: (x != "") & ~x.rlike(r"^\[.*\]$"))
    out = m.select("file_id", vtt_micros("_s").alias("start_us"), vtt_micros("_e").alias("end_us"), F.array_join(kept, " ").alias("text"))
    return out.where("text <> ''")


def class_table(lines: DataFrame) -> DataFrame:
    """name | class | speakers | episode, by bars, tabs or two spaces; the last line of a name (by
    line_no) counts."""
    f = lines.withColumn("f", F.transform(F.split("value", r"\s*\|\s*|\t+|\s{2,}"), lambda x: F.trim(x))).where("size(f) >= 2 and get(f, 0) <> '' and not startswith(get(f, 0), '#')")
    rows = f.select(F.expr("get(f, 0)").alias("name"), "line_no", F.struct(F.expr("get(f, 1)").alias("class_name"), F.expr("get(f, 2)").alias("speakers"), F.expr("get(f, 3)").alias("episode")).alias("r"))
    return rows.groupBy("name").agg(F.max_by("r", "line_no").alias("r")).select("name", "r.*")


def overlap_table(lines: DataFrame) -> DataFrame:
    """name | overlap | n_speakers | index: bad overlap and index are 0, a bad speaker count drops the line."""
    f = lines.withColumn("f", F.transform(F.split("value", r"\|"), lambda x: F.trim(x))).where("size(f) >= 3")
    n = F.expr("try_cast(get(f, 2) as int)")
    return f.where(n.isNotNull()).select(F.expr("get(f, 0)").alias("name"), F.expr("coalesce(try_cast(get(f, 1) as int), 0)").alias("overlap"), n.alias("n_speakers"), F.expr("coalesce(try_cast(get(f, 3) as int), 0)").alias("episode"))


def record_maps(lines: DataFrame) -> DataFrame:
    """One map per line: JSON, else k=v or k:v pairs; lines with neither drop out."""
    pairs = F.map_from_entries(F.transform(F.array_distinct(F.regexp_extract_all("value", F.lit(r"(\w+)\s*[=:]\s*([^\s,;|]+)"), 0)), lambda p: F.struct(F.regexp_extract(p, r"^(\w+)", 1), F.regexp_extract(p, r"[=:]\s*(.*)$", 1))))
    record = F.when(F.trim("value").startswith("{"), F.from_json("value", "map<string,string>")).when(F.col("value").rlike(r"\w\s*[=:]\s*\S"), pairs)
    return lines.withColumn("record", record).where("record is not null")


def word_runs(line: str) -> Column:
    """Every run from a word's start to a word's end in the tokens of a line; tokens are word characters
    with dashes and dots inside."""
    tokens = F.array_distinct(F.regexp_extract_all(F.col(line), F.lit(r"\w+(?:[-.]+\w+)*"), F.lit(0)))
    pieces = F.transform(tokens, lambda t: F.split(t, r"(?<=\w)(?=[-.])|(?<=[-.])(?=\w)"))
    starts = lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), "")))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda w: F.flatten(starts(w)))))


def case_of(records: DataFrame, known: DataFrame, names: list[str], line: str = "value") -> DataFrame:
    """case_id of each record: under one of the names, else the first known id (by id) that stands in its
    line as a word. The words of the lines meet the known ids by an equi-join, however many there are."""
    named = records.withColumn("_named", first_filled("record", names) if names else F.lit(None).cast("string"))
    wanted = named.where("_named is null").select(F.col(line).alias("_line")).distinct()
    met = wanted.select("_line", F.explode(word_runs("_line")).alias("case_id")).join(known.select("case_id").distinct(), "case_id")
    found = met.groupBy("_line").agg(F.min("case_id").alias("_found"))
    return named.join(found, named[line] == found["_line"], "left").withColumn("case_id", F.coalesce("_named", "_found")).drop("_named", "_found", "_line")


#: Delimiters of a metadata table, in the order in which they are tried.
DELIMITERS = ("|", "\t", ",", ";")


def _record_of(entries: str) -> Column:
    """A map of an array of structs (k, v), in which the last of a key counts."""
    return F.expr(f"map_from_entries(filter({entries}, (x, i) -> not exists(slice({entries}, i + 2, size({entries})), y -> y.k = x.k)))")


def metadata(lines: DataFrame, known: DataFrame, names: list[str], key: str = "file") -> DataFrame:
    """Records of metadata files (lines: key, line_no, value) by case: key, case_id, dialect, record. A file is read in
    the first dialect that gives it a case: JSON lines; a table under its first line, by the first of DELIMITERS
    that works; or lines that have a known id (case_id) as a word, with their k=v or k:v tokens. The last line of a
    case counts. Lines of other columns than the header, comments and lines that are no JSON drop out."""
    said = lines.select(key, "line_no", F.trim("value").alias("value")).where("value <> ''")
    columns = [key, "line_no", "value", "dialect", "record"]
    objects = said.where(F.col("value").startswith("{")).withColumn("record", F.from_json("value", "map<string,string>")).where("record is not null").withColumn("dialect", F.lit(0)).select(*columns)
    heads = said.groupBy(F.col(key).alias("_file")).agg(F.min_by("value", "line_no").alias("_head"), F.min("line_no").alias("_first"))
    under = said.join(heads, said[key].eqNullSafe(heads["_file"])).where("line_no > _first and not startswith(value, '#')")
    tables = None
    for i, d in enumerate(DELIMITERS, 1):
        split = lambda c: F.transform(F.split(c, re.escape(d)), lambda x: F.trim(x))  # noqa: B023, E731
        rows = under.where(F.contains("_head", F.lit(d)) & F.contains("value", F.lit(d))).withColumn("_names", split(F.col("_head"))).withColumn("_parts", split(F.col("value")))
        rows = rows.where("size(_names) = size(_parts)").withColumn("_entries", F.expr("zip_with(_names, _parts, (k, v) -> named_struct('k', k, 'v', v))"))
        made = rows.withColumn("record", _record_of("_entries")).withColumn("dialect", F.lit(i)).select(*columns)
        tables = made if tables is None else tables.unionByName(made)
    told = case_of(objects.unionByName(tables), known, names)
    token = "trim(t)"
    entry = lambda sign: f"named_struct('k', trim(ltrim('#', trim(substring_index({token}, '{sign}', 1)))), 'v', trim(substr({token}, instr({token}, '{sign}') + 1)))"
    free = said.withColumn("_entries", F.expr(f"transform(filter(split(value, '[|,;]'), t -> {token} <> '' and (contains(t, '=') or contains(t, ':'))), t -> if(contains(t, '='), {entry('=')}, {entry(':')}))"))
    loose = case_of(free.withColumn("record", _record_of("_entries")).withColumn("dialect", F.lit(len(DELIMITERS) + 1)).select(*columns), known, [])
    every = told.select(*columns, "case_id").unionByName(loose.select(*columns, "case_id")).where("case_id is not null")
    first = every.groupBy(F.col(key).alias("_file")).agg(F.min("dialect").alias("_best"))
    best = every.join(first, every[key].eqNullSafe(first["_file"])).where("dialect = _best")
    return best.groupBy(key, "case_id").agg(F.first("dialect").alias("dialect"), F.max_by("record", "line_no").alias("record"))


def predictions(rows: DataFrame) -> DataFrame:
    """Rows of a predictions CSV (all text): empty texts and bad times drop out, a missing speaker comes
    from the data name."""
    r = rows.withColumn("start_us", micros("start")).withColumn("end_us", micros("`end`")).withColumn("text", clean_text(F.col("predicted_text")))
    speaker = F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.element_at(F.split("data_name", "_"), -1))
    retried = F.expr("lower(was_retried) = 'true'")
    return r.where("start_us is not null and end_us is not null and text <> ''").select("data_name", speaker.alias("speaker"), "start_us", "end_us", "text", retried.alias("was_retried"))


def prediction_counters(rows: DataFrame) -> DataFrame:
    """Rows of a predictions CSV by what predictions() does with them: read, without text, with bad times (of
    those with text), kept."""
    text, timed = clean_text(F.col("predicted_text")) != "", micros("start").isNotNull() & micros("`end`").isNotNull()
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~text).alias("no_text"), F.count_if(text & ~timed).alias("bad_times"), F.count_if(text & timed).alias("kept"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return predictions(spark.read.option("header", True).csv(path))


def alignments(files: DataFrame) -> DataFrame:
    """Word alignment JSON files (value, path): words by audio id without .wav; the last path counts."""
    words = "array<struct<word:string,start:double,end:double,duration:double>>"
    r = files.withColumn("j", F.from_json("value", f"file string, audio_id string, words {words}")).where("j.audio_id is not null")
    keyed = r.withColumn("audio_id", F.regexp_replace("j.audio_id", r"\.wav$", ""))
    return keyed.groupBy("audio_id").agg(F.max_by("j.words", "path").alias("words"))


def prompts(lines: DataFrame) -> DataFrame:
    """id TAB text or id text; speakerX_N becomes common_voice_vi_XN."""
    p = r"^(\S+)[\t ]+(.*)$"
    m = lines.where(F.col("value").rlike(p)).withColumn("id", F.regexp_extract("value", p, 1))
    return m.select(F.regexp_replace("id", r"^speaker(\d+)_(\d+)$", "common_voice_vi_$1$2").alias("id"), F.trim(F.regexp_extract("value", p, 2)).alias("text"))


def prompt_texts(alignments: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, text): words of alignments joined, and prompts of lines, which count where both have an id."""
    aligned = alignments.where(F.size("words") > 0).select(F.col("audio_id").alias("id"), F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"))
    return first_source(prompts(lines), aligned, key="id")


def files_by_folder(listing: DataFrame, priority: list[str], name: str) -> DataFrame:
    """The file of each folder whose name comes first in priority (listing: folder, file)."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("file"))
    return listing.where(rank > 0).groupBy("folder").agg(F.min_by("file", rank).alias(name))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """folder, file, modified, size of everything below a path, contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def checkpoints(listing: DataFrame) -> DataFrame:
    """Checkpoints in order: class (baseline, best, epoch, other), epoch, name; the first of a label."""
    label = F.regexp_replace(F.lower("file"), r"\.(ckpt|pt|bin)$", "")
    kind = F.when(label.contains("baseline"), 0).when(label.contains("best"), 1).when(label.rlike(r"ep\d+"), 2).otherwise(3)
    epoch = F.expr("coalesce(try_cast(regexp_extract(lower(file), 'ep(\\\\d+)', 1) as int), 0)")
    return listing.select(label.alias("label"), kind.alias("kind"), epoch.alias("epoch"), "file").groupBy("label").agg(F.min(F.struct("kind", "epoch", "file")).alias("order")).select("label", "order.*")
