"""String functions of the transcript tools, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = " ... "


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC, which Spark SQL has no function for."""
    for series in texts:
        yield series.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_spoken(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces. Texts must be in NFC, or marks are lost."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\s]", " "), r"\s+", " "))


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalize_name(text: Column) -> Column:
    """Lower case, other than letters, digits and _ to _, no _ at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^0-9a-z_]+", "_"), "^_+|_+$", "")


def slug(text: Column) -> Column:
    """Letters, digits, dot, dash and _; 'unknown' for nothing."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(cut == "", F.lit("unknown")).otherwise(cut)


def normalize_group(text: Column) -> Column:
    """Lower case, - and _ as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-_", "  "), r"\s+", " "))


def stable_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("||", *parts))


def folder_name(text: Column) -> Column:
    """Runs of characters that file names should not have become _; no _ . or space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^[_. ]+|[_. ]+$", "")


def speaker_of(name: Column) -> Column:
    """The part behind the last _, the whole without one; 'speaker_unknown' for nothing."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("speaker_unknown")).otherwise(F.element_at(F.split(name, "_"), -1))


def number_in(column: str) -> Column:
    """The first number in a text, null without one."""
    return F.expr(rf"try_cast(regexp_extract({column}, '-?\\d+(?:\\.\\d+)?', 0) as double)")


def overlap_bucket(value: Column) -> Column:
    """'ov' and the number without a trailing .0; 'unknown' for null."""
    whole = value == F.floor(value)
    return F.when(value.isNull(), F.lit("unknown")).when(whole, F.concat(F.lit("ov"), F.floor(value).cast("string"))).otherwise(F.concat(F.lit("ov"), value.cast("string")))


def clock(seconds: Column) -> Column:
    """h:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def minutes_seconds(seconds: Column) -> Column:
    """mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def short_duration(hundredths: Column) -> Column:
    """'1.25s' under a minute, else '2m 5s'; from hundredths of a second."""
    h = F.greatest(F.lit(0).cast("long"), hundredths.cast("long"))
    return F.when(h < 6000, F.format_string("%d.%02ds", F.floor(h / 100), h % 100)).otherwise(F.format_string("%dm %ds", F.floor(h / 6000), F.floor(h / 100) % 60))


def vtt_micros(stamp: str) -> Column:
    """Microseconds of hh:mm:ss.mmm or mm:ss.mmm (a comma counts as the dot)."""
    p = f"split(replace({stamp}, ',', '.'), ':')"
    return F.expr(f"cast(aggregate({p}, 0L, (a, x) -> a * 60 + cast(split(x, '[.]')[0] as bigint)) * 1000000 + cast(rpad(coalesce(get(split({stamp}, '[.,]'), 1), '0'), 6, '0') as bigint) as bigint)")


def split_speaker(line: Column) -> list[Column]:
    """Speaker and text of 'SPEAKER: text'."""
    pattern = r"^\s*([^:|]{1,40}?)\s*:\s*(.*)$"
    return [F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("speaker"), F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 2)).otherwise(line).alias("said")]


def replace_literal(text: Column, find: str, put: str) -> Column:
    """Case-insensitive replacement of a literal."""
    import re

    return F.regexp_replace(text, "(?i)" + re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", find), put.replace("\\", "\\\\").replace("$", r"\$"))


def sentence(text: Column) -> Column:
    """Capital first letter, no space before punctuation, a stop at the end."""
    tight = F.regexp_replace(F.trim(text), r"\s+([.,!?;:])", "$1")
    capital = F.concat(F.upper(F.substring(tight, 1, 1)), F.substring(tight, 2, 1 << 30))
    return F.when(capital.rlike(r"[.!?]$") | (capital == ""), capital).otherwise(F.concat(capital, F.lit(".")))


def joined_sentences(texts: Column) -> Column:
    """Texts of an array in a row: a text that begins with a capital letter closes the one before with a stop, if
    that has no mark at its end; empty texts drop out."""
    kept = F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    first = lambda t: F.substring(t, 1, 1)
    capital = lambda t: (F.upper(first(t)) == first(t)) & (F.lower(first(t)) != first(t))

    def piece(all_: Column):
        before = lambda i: F.when(i == 0, F.lit("")).when(~F.get(all_, i - 1).rlike("[.?!,:;]$") & capital(F.get(all_, i)), F.lit(". ")).otherwise(F.lit(" "))
        return F.array_join(F.transform(all_, lambda t, i: F.concat(before(i), t)), "")

    return F.get(F.transform(F.array(kept), piece), F.lit(0))


def query_value(url: Column, key: str) -> Column:
    """A query parameter's value, null without it."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]+)", 1), F.lit(""))


def rouge_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(text)), r"\s+"), lambda x: x != "")


def json_object_in(text: Column) -> Column:
    """The text from the first { to the last }, without code fences; null without one."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def head_and_tail(text: Column, most: int) -> Column:
    """Texts longer than most keep their ends around a marker; of an odd number the tail has more."""
    head, tail = most // 2, -(-most // 2)
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(MARKER), F.right(text, F.lit(tail)))).otherwise(text)


def natural_key(text: Column) -> Column:
    """A sort key in which numbers count by value: digit runs padded to 12."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), 0), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def phrase_hit(text: Column, phrases: list[str], single: list[str]) -> Column:
    """A phrase anywhere, or the whole text one of some single words."""
    low = F.trim(F.lower(text))
    return F.exists(F.array(*map(F.lit, phrases)), lambda k: F.contains(low, k)) | low.isin(*single)
