"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Rules: counts of words, symbols, repeated lines and repeated 3-word windows of each whole text.
Model: two multinomials over hashed n-grams, one of trusted texts (the target), one of the whole raw
corpus. The n-grams of a text are its words and its pairs of neighbouring words, each order with a
multinomial of its own; the target's is shrunk towards the raw one, so that rare n-grams and small
samples say little. A text's score is the mean, over its n-grams, of log p_target - log p_raw, in
whole millionths, so sums do not depend on order. A text is kept if
the rules hold and its score is THRESHOLD or more, for every text alike.

Plan: corpus counts are one exploded, partially aggregated pass (2 * buckets groups at most, whatever
the corpus; buckets is a parameter, to be raised with the vocabulary); the ratio table has that many numbers and comes back as a literal array, so scoring is a
projection without a shuffle. Trusted texts are a bounded sample: the TRUSTED rows of quality 1 with
the smallest seeded hash, broadcast under that bound; raw counts cover all texts.

Repeated windows: the 64-bit hashes of a text's windows are sorted with their places; a window counts
if a neighbour in that order has its hash. (Two different windows of one text share a 64-bit hash with
a chance below n^2 / 2^65.)

Edge cases: a null or wordless text has no words, fails the rules and is not kept; fewer than three
words make no window; an empty table gives an empty result; without trusted rows every score is 0.
Ids are only used to find trusted rows, so null or repeated ids and equal texts are rows like any other;
a very long text is one row's arrays. Ties of the hash that picks trusted rows go by id. Other columns of
the input, whatever their names, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced

#: Buckets of each order of n-grams, a parameter of assess().
BUCKETS = 1 << 14
TRUSTED = 20_000
SEED = 17
#: Pseudo-count of the shrinkage: a bucket counts little until so many target n-grams are expected in it.
PRIOR = 20.0
#: Least mean log ratio, in nats an n-gram.
THRESHOLD = -0.09
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Array of the words of a text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _windows(w: str) -> str:
    return f"if(size({w}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))"


def with_rules(rows: DataFrame, w: str = "w", text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    hashed = rows.withColumn("windows", F.expr(_windows(w)))
    lines = hashed.withColumn("lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Windows with their places, in the order of their hashes, only where any hash comes twice.
    paired = lines.withColumn(
        "sorted",
        F.expr(
            "if(size(array_distinct(windows)) = size(windows), cast(array() as array<struct<h:bigint,p:int>>),"
            " sort_array(transform(windows, (h, p) -> named_struct('h', h, 'p', p))))"
        ),
    )
    twice = paired.withColumn("twice", F.expr("sort_array(transform(filter(sorted, (x, i) -> (i > 0 and sorted[i - 1].h = x.h) or (i < size(sorted) - 1 and sorted[i + 1].h = x.h)), x -> x.p))"))
    counted = twice.select(
        *(c for c in rows.columns),
        F.size(w).cast("long").alias("n_words"),
        F.coalesce(F.char_length(F.array_join(w, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.char_length(F.regexp_replace(text, f"[^{_SYMBOLS}]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # Places in order: each adds the words that the one before has not covered.
        F.expr("aggregate(twice, named_struct('n', 0L, 'end', -1), (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.end, p), 'end', p + 3)).n").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _grams(w: str, buckets: int) -> str:
    """Bucket numbers of the n-grams: words in [0, buckets), word pairs in [buckets, 2 buckets)."""
    one = f"transform({w}, x -> cast(pmod(xxhash64(x), {buckets}) as int))"
    two = f"transform(sequence(0, size({w}) - 2), i -> cast({buckets} + pmod(xxhash64({w}[i], {w}[i + 1]), {buckets}) as int))"
    return f"if(size({w}) < 2, {one}, concat({one}, {two}))"


def ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> list[int]:
    """log p_target - log p_raw of each bucket, in millionths."""
    trusted = labels.where("quality = 1").select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(TRUSTED)
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    marked = rows.join(F.broadcast(trusted.withColumn("target", F.lit(1))), "id", "left")  # TRUSTED rows at most
    # The outer form: for explode() Catalyst infers a filter on the array's size, pushes it below the
    # projection of w, and so splits the text anew for every word.
    grams = marked.select("target", F.explode_outer(F.expr(_grams("w", buckets))).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("target").alias("target")).collect()
    raw, target = [0] * (2 * buckets), [0] * (2 * buckets)
    for r in counts:
        raw[r.b], target[r.b] = r.raw, r.target
    if not any(target):
        return [0] * (2 * buckets)
    out = []
    for lo in (0, buckets):  # words and pairs are multinomials of their own
        part = slice(lo, lo + buckets)
        n_raw, n_target = sum(raw[part]) or 1, sum(target[part])
        share = [r / n_raw for r in raw[part]]
        # Counts against what the raw share lets expect, both shrunk by PRIOR: without evidence, no ratio.
        rate = [(t + PRIOR) / (n_target * p + PRIOR) for t, p in zip(target[part], share, strict=True)]
        whole = sum(p * x for p, x in zip(share, rate, strict=True)) or 1.0
        out += [round(1e6 * math.log(x / whole)) for x in rate]
    return out


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Per input row: id, rule counts, base_failed, llr (mean log ratio), kept."""
    table = ratios(docs, labels, id_col, text_col, buckets)
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), words(F.col(text_col)).alias("w"))
    ruled = with_rules(rows).withColumn("g", F.expr(_grams("w", buckets))).withColumn("llr_table", literal)
    scored = ruled.withColumn("total", F.expr("aggregate(g, 0L, (a, b) -> a + llr_table[b])"))
    llr = F.when(F.size("g") > 0, F.col("total") / (1e6 * F.size("g"))).otherwise(0.0)
    kept = ~F.col("base_failed") & (F.col("total") >= F.lit(round(THRESHOLD * 1e6)) * F.size("g").cast("long"))
    return fenced(scored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", llr.alias("llr"), kept.alias("kept")))
