"""Sequence and diarization metrics.

Word distances are bit-parallel: the rows of the distance table are the bits of one integer, so a word of
the other side costs a few operations on integers of as many bits, and memory is a column of the table.
They run in Arrow passes over two columns of words (nulls count as no words). The split into substitutions,
deletions and insertions walks back through the columns, which are made again from kept ones in stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.operators import intervals as I
from turnlake.operators.joins import range_join, right_side
from turnlake.operators.shared import stream_groups


def _places(words: list[str]) -> dict[str, int]:
    """Of each different word, the bits of its places."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _columns(places: dict[str, int], full: int, state: tuple[int, int], words: list[str]) -> Iterator[tuple[int, int, int, int]]:
    up, down = state
    for w in words:
        same = places.get(w, 0)
        near = same | down
        carried = ((((same & up) + up) & full) ^ up) | same
        right, left = down | ~(carried | up) & full, up & carried
        # The first row grows by one with every column.
        r, d = (right << 1 | 1) & full, left << 1 & full
        up, down = d | ~(near | r) & full, r & near
        yield up, down, right, left


def levenshtein_columns(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Columns of the edit distance table of a (rows) and b, as bit vectors of the steps of plus and minus
    one: down the column (up, down), and from the column before (right, left)."""
    full = (1 << len(a)) - 1
    return _columns(_places(a), full, (full, 0), b)


#: Columns of a table that are held at once, and columns kept of a longer stretch to start again from.
HELD_COLUMNS, KEPT_COLUMNS = 256, 16


def columns_from_end(a: list[str], b: list[str]) -> Iterator[tuple[tuple[int, int, int, int], tuple[int, int]]]:
    """levenshtein_columns from the last to the first, each with (up, down) of the column before it. A stretch
    that is too long to hold is run once for KEPT_COLUMNS of its columns, then its parts from the last on, so that
    memory is some hundred columns, whatever the length, and time a factor of the logarithm to base KEPT_COLUMNS."""
    places, full = _places(a), (1 << len(a)) - 1

    def stretch(lo: int, hi: int, state: tuple[int, int]) -> Iterator[tuple[tuple[int, int, int, int], tuple[int, int]]]:
        if hi - lo <= HELD_COLUMNS:
            held = list(_columns(places, full, state, b[lo:hi]))
            for k in range(len(held) - 1, -1, -1):
                yield held[k], held[k - 1][:2] if k else state
            return
        step = -(-(hi - lo) // KEPT_COLUMNS)
        kept = [state]
        for k, column in enumerate(_columns(places, full, state, b[lo : lo + (KEPT_COLUMNS - 1) * step]), 1):
            if k % step == 0 and lo + k < hi:
                kept.append(column[:2])
        for k in range(len(kept) - 1, -1, -1):
            yield from stretch(lo + k * step, min(hi, lo + (k + 1) * step), kept[k])
            kept.pop()

    return stretch(0, len(b), (full, 0))


def levenshtein(a: list[str], b: list[str]) -> int:
    if not a or not b:
        return len(a) + len(b)
    last, cost = 1 << len(a) - 1, len(a)
    for _, _, right, left in levenshtein_columns(a, b):
        cost += bool(right & last) - bool(left & last)
    return cost


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the zeros that are left of a row of ones."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def back_trace(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of one best alignment; from the end, a match is preferred over
    a substitution, that over a deletion, that over an insertion."""
    s = d = k = 0
    i, j = len(ref), len(hyp)
    for (up, down, right, left), (before_up, before_down) in columns_from_end(ref, hyp) if ref else ():
        while i:
            bit = 1 << i - 1
            # The cell's cost less that of the cells above, to the left, and diagonally before it.
            above = bool(up & bit) - bool(down & bit)
            beside = bool(right & bit) - bool(left & bit)
            diagonal = beside + bool(before_up & bit) - bool(before_down & bit)
            if (diagonal == 0 and ref[i - 1] == hyp[j - 1]) or diagonal == 1:
                s, i, j = s + diagonal, i - 1, j - 1
                break
            if above == 1:
                d, i = d + 1, i - 1
            else:
                k, j = k + 1, j - 1
                break
        if not i:
            break
    return s, d + i, k + j


def _over_words(kind: str, score: Callable[[list[str], list[str]], object], out: pa.DataType):
    """An Arrow function of two columns of words."""

    @F.arrow_udf(kind)
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            yield pa.array([score(x.as_py() or [], y.as_py() or []) for x, y in zip(a, b, strict=True)], out)

    return run


def edit_distance(a: str, b: str) -> Column:
    """Word edit distance of two array columns."""
    return _over_words("int", levenshtein, pa.int32())(F.col(a), F.col(b))


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two array columns."""
    return _over_words("int", common_subsequence, pa.int32())(F.col(a), F.col(b))


def word_errors(ref: str, hyp: str) -> Column:
    """struct<substitutions, deletions, insertions> of a best alignment."""
    names = ("substitutions", "deletions", "insertions")
    split = lambda r, h: dict(zip(names, back_trace(r, h), strict=True))
    return _over_words(f"struct<{', '.join(f'{n}: int' for n in names)}>", split, pa.struct([(n, pa.int32()) for n in names]))(F.col(ref), F.col(hyp))


def rouge_l(a: str, b: str) -> Column:
    """F1 of the LCS against both lengths; 0 if either side has no words."""

    def score(x: list[str], y: list[str]) -> float:
        return 2.0 * common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0

    return _over_words("double", score, pa.float64())(F.col(a), F.col(b))


def token_similarity(a: str, b: str) -> Column:
    """Common words over the larger word set; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


@F.arrow_udf(T.DoubleType())
def compression_ratio(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """UTF-8 bytes over deflated bytes; 0 for an empty text."""
    import zlib

    for batch in texts:
        yield pa.array([len(b := t.encode()) / len(zlib.compress(b)) if (t := x.as_py()) else 0.0 for x in batch], pa.float64())


def repeats_or_rushes(words: str, duration_s: Column) -> Column:
    """More than 8 words a second, or 8 words and more whose first half is their second."""
    n = F.size(words)
    half = F.expr(f"size({words}) >= 8 and slice({words}, 1, cast(size({words}) div 2 as int)) = slice({words}, cast(size({words}) div 2 as int) + 1, cast(size({words}) div 2 as int))")
    return (n > duration_s * 8) | half


def contains_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda k: F.contains(F.lower(text), k))


def snr_db(signal: str, noise: str) -> Column:
    """10 log10 of the mean squares' ratio of two array columns."""
    power = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(c)
    return 10 * F.log10(power(signal) / power(noise))


def mix_at_snr(signal: str, noise: str, snr: Column) -> Column:
    """Signal plus noise, scaled so that their mean squares' ratio is snr (dB); equally long arrays."""
    power = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(c)
    gain = F.when(power(noise) > 0, F.sqrt(power(signal) / (power(noise) * F.pow(F.lit(10.0), snr / 10)))).otherwise(F.lit(0.0))
    added = F.transform(F.array(gain), lambda g: F.zip_with(F.col(signal), F.col(noise), lambda s, n: s.cast("double") + g * n))
    return F.get(added, F.lit(0))


def der(ref: DataFrame, hyp: DataFrame, keys: tuple[str, ...] = ("file_id",), mapping: dict[str, str] | None = None) -> DataFrame:
    """Per recording: reference time, miss, false alarm, confusion (microseconds), overlap time hit.
    Each speaker's own segments are merged first. Labels are compared as they are; mapping renames the
    hypothesis' speakers, the same in all recordings. der_mapped() finds the best names first."""
    h = hyp if not mapping else hyp.replace(mapping, subset=["speaker"])
    columns = [*keys, "speaker", "start_us", "end_us"]
    r, h = I.by_speaker(ref, keys).select(*columns), I.by_speaker(h, keys).select(*columns)
    # A speaker's merged segments of both sides overlap where both have them.
    both = I.overlap_regions(r.unionByName(h), (*keys, "speaker"))
    change = lambda df, *by: df.select(*keys, F.explode(F.array(*(F.struct(F.col(t).alias("t"), *(F.lit(x * sign).alias(n) for n, x in zip(("nr", "nh", "nc"), by, strict=True))) for t, sign in (("start_us", 1), ("end_us", -1))))).alias("m"))
    marks = change(r, 1, 0, 0).unionByName(change(h, 0, 1, 0)).unionByName(change(both, 0, 0, 1))
    summed = marks.groupBy(*keys, F.col("m.t").alias("t")).agg(*(F.sum(f"m.{n}").alias(n) for n in ("nr", "nh", "nc")))
    order = Window.partitionBy(*keys).orderBy("t")
    counts = summed.select(*keys, *(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in ("nr", "nh", "nc")), (F.lead("t").over(order) - F.col("t")).alias("d")).where("d is not null")
    zero = F.lit(0).cast("long")
    total = lambda c: F.sum(c).cast("long")
    both2 = F.when((F.col("nr") >= 2) & (F.col("nh") >= 2), F.col("d")).otherwise(zero)
    return counts.groupBy(*keys).agg(
        total(F.col("d") * F.col("nr")).alias("ref_us"),
        total(F.col("d") * F.greatest(zero, F.col("nr") - F.col("nh"))).alias("miss_us"),
        total(F.col("d") * F.greatest(zero, F.col("nh") - F.col("nr"))).alias("fa_us"),
        total(F.col("d") * (F.least("nr", "nh") - F.col("nc"))).alias("conf_us"),
        total(both2).alias("ov_both_us"),
        total(F.when(F.col("nh") >= 2, F.col("d")).otherwise(zero)).alias("ov_hyp_us"),
        total(F.when(F.col("nr") >= 2, F.col("d")).otherwise(zero)).alias("ov_ref_us"),
    )


def der_rates(times: DataFrame) -> DataFrame:
    """Adds der, and precision, recall and f1 of overlapped speech, to the times of der(); a rate over no
    time is 0."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    errors = F.col("miss_us") + F.col("fa_us") + F.col("conf_us")
    p, r = over(F.col("ov_both_us"), F.col("ov_hyp_us")), over(F.col("ov_both_us"), F.col("ov_ref_us"))
    rated = times.withColumn("der", over(errors, F.col("ref_us"))).withColumn("ov_precision", p).withColumn("ov_recall", r)
    return rated.withColumn("ov_f1", over(2.0 * F.col("ov_both_us"), F.col("ov_hyp_us") + F.col("ov_ref_us")))


#: Tokens that a recogniser's alphabet has besides letters.
SPECIAL_TOKENS = ["<pad>", "<unk>", "<s>", "</s>"]
JOINED = "##"


def token_word_times(rows: DataFrame, tokens: str = "tokens", words: str = "words", duration_us: str = "duration_us") -> DataFrame:
    """Adds times, array<struct<word, start_us, end_us>>: the words of a text over the frames of a recogniser's
    tokens (one a frame). Special tokens and repeats of the token before go, joined ones belong to the one
    before; what is left is dealt to the words in equal shares, and a word lasts from its first token's frame
    to its last. Without tokens or words the array is empty."""
    special = ", ".join(f"'{t}'" for t in SPECIAL_TOKENS)
    told = rows.withColumn("_told", F.expr(f"filter(transform({tokens}, (t, i) -> named_struct('t', t, 'i', i)), x -> x.t not in ({special}))"))
    kept = told.withColumn("_kept", F.expr("filter(_told, (x, k) -> k = 0 or x.t <> get(_told, k - 1).t)"))
    framed = kept.withColumn("_frames", F.expr(f"transform(filter(_kept, (x, k) -> k = 0 or not startswith(x.t, '{JOINED}')), x -> x.i)"))
    n, m = "size(_frames)", f"size({words})"
    lo = f"least(cast(floor(i * (cast({n} as double) / {m})) as int), {n} - 1)"
    hi = f"least(cast(floor((i + 1) * (cast({n} as double) / {m})) as int), {n})"
    at = lambda frame: f"cast(floor({frame} * cast({duration_us} as double) / size({tokens}) + 0.5) as bigint)"
    each = f"transform({words}, (w, i) -> named_struct('word', w, 'start_us', {at(f'get(_frames, {lo})')}, 'end_us', {at(f'get(_frames, if({hi} > 0, {hi} - 1, {lo}))')}))"
    times = f"if(coalesce({n}, 0) <= 0 or coalesce({m}, 0) <= 0, cast(array() as array<struct<word:string,start_us:bigint,end_us:bigint>>), {each})"
    return framed.withColumn("times", F.expr(times)).drop("_told", "_kept", "_frames")


def assignment(weights: list[list[int]]) -> list[int]:
    """Column of each row (-1: none) in a one-to-one assignment of the largest sum; weights are 0 at least.
    Shortest augmenting paths with potentials, cubic in the larger side; of equal sums the first found."""
    n, m = len(weights), max(len(weights), len(weights[0]) if weights else 0)
    cost = [[-w for w in row] + [0] * (m - len(row)) for row in weights]
    row_price, col_price, owner = [0] * n, [0] * (m + 1), [-1] * (m + 1)  # column m stands for the start
    for start in range(n):
        owner[m], at = start, m
        least, via, done = [None] * m, [m] * m, [False] * (m + 1)
        while owner[at] != -1:
            done[at], r = True, owner[at]
            step, to = None, -1
            for c in range(m):
                if done[c]:
                    continue
                reach = cost[r][c] - row_price[r] - col_price[c]
                if least[c] is None or reach < least[c]:
                    least[c], via[c] = reach, at
                if step is None or least[c] < step:
                    step, to = least[c], c
            for c in range(m + 1):
                if done[c]:
                    row_price[owner[c]] += step
                    col_price[c] -= step
                elif c < m:
                    least[c] -= step
            at = to
        while at != m:
            owner[at], at = owner[via[at]], via[at]
    out = [-1] * n
    for c in range(m):
        if owner[c] != -1 and c < len(weights[owner[c]]):
            out[owner[c]] = c
    return out


def speaker_mapping(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one mapping of hypothesis to reference speakers with the most shared time, per recording.
    What a recording's task holds is its table of shared times, speakers by speakers."""
    pairs = range_join(hyp, right_side(ref, keys), keys).withColumn("ov", F.expr("least(end_us, r_end_us) - greatest(start_us, r_start_us)"))
    shared = pairs.groupBy(*keys, "speaker", "r_speaker").agg(F.sum("ov").alias("shared_us"))
    schema = T.StructType([*(ref.schema[k] for k in keys), T.StructField("speaker", T.StringType()), T.StructField("r_speaker", T.StringType()), T.StructField("shared_us", T.LongType())])

    def best(key: tuple, rows: list[tuple]) -> list[tuple]:
        w = {(h or "", r or ""): v for h, r, v in rows}
        hs, rs = (sorted({pair[side] for pair in w}) for side in (0, 1))
        chosen = assignment([[w.get((h, r), 0) for r in rs] for h in hs])
        return [(*key, h, rs[c], w[h, rs[c]]) for h, c in zip(hs, chosen, strict=True) if c >= 0 and w.get((h, rs[c]))]

    return stream_groups(shared, keys, ["speaker", "r_speaker"], best, schema)


def der_mapped(ref: DataFrame, hyp: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """der() under the one-to-one mapping of speakers that makes the error least, per recording: confusion is
    what the smaller side says less what mapped pairs share, so the mapping of most shared time is best. Speakers'
    own segments are merged before time is shared. A hypothesis speaker without a partner stays apart from all
    reference speakers, also from one of the same name."""
    columns = [*keys, "speaker", "start_us", "end_us"]
    r = I.by_speaker(ref, keys).select(*columns).withColumn("speaker", F.col("speaker").cast("string"))
    h = I.by_speaker(hyp, keys).select(*columns).withColumn("speaker", F.col("speaker").cast("string"))
    names = speaker_mapping(r, h, list(keys)).select(*keys, "speaker", "r_speaker")
    renamed = h.join(names, [*keys, "speaker"], "left").withColumn("speaker", F.coalesce(F.concat(F.lit("r"), "r_speaker"), F.concat(F.lit("h"), "speaker"), F.lit("h"))).select(*columns)
    return der(r.withColumn("speaker", F.concat(F.lit("r"), F.coalesce("speaker", F.lit("")))), renamed, keys)


def centroid_assignment(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Label of the centroid with the highest cosine for each vector; centroids (label, centroid) are
    a fixed few (one per speaker). Ties go to the smallest label."""
    table = centroids.groupBy().agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("table"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.join(table, F.lit(True)).withColumn("s", F.transform("table", lambda t: F.struct((dot(F.col(vector), t["centroid"]) / (norm(F.col(vector)) * norm(t["centroid"]))).alias("cosine"), (-t["label"]).alias("less"))))
    return scored.withColumn("best", F.array_max("s")).withColumn("assigned", (-F.col("best.less")).cast("int")).withColumn("cosine", F.col("best.cosine")).drop("table", "s", "best")
