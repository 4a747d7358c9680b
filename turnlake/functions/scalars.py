"""Numeric, conditional and lookup functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Overlap percent up to which a tier holds; gaps between ranges fall to the last tier.
TIERS = ((0, 0, "tier_A_0pct"), (5, 10, "tier_B_5_10pct"), (15, 15, "tier_C_15pct"))
LAST_TIER = "tier_D_20_30pct"
#: Buckets of recordings by class.
CLASS_BUCKETS = {
    "vif": "gold_real",
    "conan": "silver_real",
    "dustin_on_go": "silver_real",
    "dustin": "silver_real",
    "chuyen_ho_chuyen_minh": "silver_real",
    "chuyen_ho": "silver_real",
    "coi_mo": "hard_real",
    "coi_moi": "hard_real",
}
OTHER_BUCKET = "silver_real"
#: Keys that a summary must have.
SUMMARY_KEYS = ["meeting_overview", "conversation_main_summary", "meeting_type", "segments", "action_items", "speaker_insights", "speaker_main_summaries", "cleaned_transcript"]
#: Weights of the summary score without and with a reference, words from which on a summary is long and
#: the words that then cost all of its compactness, and the least scores of the labels.
SCORE_WEIGHTS = {"schema": 0.35, "evidence": 0.35, "specific": 0.15, "compact": 0.15}
REFERENCE_WEIGHTS = {"plain": 0.25, "rouge": 0.35, "speaker_rouge": 0.40}
LONG_WORDS, LONG_SPAN = 30, 50
SCORE_LABELS = ((0.75, "good"), (0.55, "usable"))
LAST_LABEL = "needs_review"


def safe_double(column: str, default: float = 0.0) -> Column:
    return F.coalesce(F.expr(f"try_cast({column} as double)"), F.lit(default))


def first_present(record: str, names: list[str]) -> Column:
    """The value of the first name that a map has, null values included."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.map_contains_key(record, F.lit(n)), F.col(record)[n]).otherwise(out)
    return out


def first_filled(record: str, names: list[str]) -> Column:
    """The first value of a map under the names that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(F.col(record), F.lit(n))), F.lit("")) for n in names))


def overlap_tier(value: Column) -> Column:
    out = F.lit(LAST_TIER)
    for lo, hi, tier in reversed(TIERS):
        out = F.when(value.between(lo, hi), F.lit(tier)).otherwise(out)
    return out


def capped(value: Column, most: int) -> Column:
    return F.least(value, F.lit(most))


def phase_value(phases: str, index: Column) -> Column:
    """An array's element by phase (from 0); the last holds from then on."""
    return F.element_at(F.col(phases), F.least(index + 1, F.size(phases)))


def threshold_grid(start: int, stop: int, step: int) -> Column:
    """Thresholds in ten-thousandths, as an exact array."""
    return F.sequence(F.lit(start), F.lit(stop), F.lit(step))


def speaker_folder(n: Column) -> Column:
    """spk1 to spk4, spk5plus from five speakers on."""
    return F.when(n <= 4, F.concat(F.lit("spk"), n.cast("string"))).otherwise(F.lit("spk5plus"))


def class_bucket(name: Column) -> Column:
    """The bucket of a normalised class name."""
    table = F.create_map(*(F.lit(x) for kv in CLASS_BUCKETS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), F.lit(OTHER_BUCKET))


def quality_score(schema: Column, evidence: Column, generic: Column, average_words: Column) -> Column:
    """Weighted score of a summary without a reference; long summaries lose compactness."""
    compact = F.when(average_words <= LONG_WORDS, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (average_words - LONG_WORDS) / LONG_SPAN))
    parts = {"schema": schema, "evidence": evidence, "specific": 1 - generic, "compact": compact}
    return sum((F.lit(SCORE_WEIGHTS[k]) * parts[k] for k in SCORE_WEIGHTS), F.lit(0.0))


def quality_score_with_reference(plain: Column, rouge: Column, speaker_rouge: Column) -> Column:
    """The score without a reference, drawn to the summary's and the speakers' ROUGE-L; null: none."""
    parts = {"plain": plain, "rouge": rouge, "speaker_rouge": F.coalesce(speaker_rouge, F.lit(0.0))}
    drawn = sum((F.lit(REFERENCE_WEIGHTS[k]) * parts[k] for k in REFERENCE_WEIGHTS), F.lit(0.0))
    return F.when(rouge.isNull(), plain).otherwise(drawn)


def quality_label(score: Column) -> Column:
    out = F.lit(LAST_LABEL)
    for least, label in reversed(SCORE_LABELS):
        out = F.when(score >= least, F.lit(label)).otherwise(out)
    return out


def meetings_needed(hours: Column, minutes_each: Column) -> Column:
    """Meetings of a length that fill a budget of hours, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(hours * 60 / minutes_each).cast("long"))
