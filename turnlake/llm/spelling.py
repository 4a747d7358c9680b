"""Spelling variants: words one inserted, deleted or replaced code point apart, by rolling-hash deletions.

Words are counted where the texts are, task by task in a table that is handed on before it grows large.
Every word of the vocabulary gets integer keys: one of the whole word, one of every deletion of a code point.
They come from prefix and suffix sums of c * B^j modulo two primes of 31 bits, over all code points of a
batch at once: a deletion keeps its prefix, and its suffix is divided by B. Words differ

  * by a replacement at i if their deletions at i are equal: key of (length, i, deletion);
  * by a deletion if the shorter word is a deletion of the longer: key of (length, whole) on both sides; of
    equal neighbours only the first is deleted here, so every pair is met once.

Keys are radix-partitioned by their leading bits and sorted; neighbours of equal keys are candidate pairs,
which meet their strings and are verified letter by letter. A key of replacements has at most as many words as
there are letters, one of deletions that many for each place, so groups of keys are bounded by the alphabet
and the word's length, never by the vocabulary. Keys travel with numbers, not with strings, so that a very
long word costs its length, not its square. A word's form has at least twice its occurrences, so chains of
forms are short, and pointers that double find their last word in few rounds.

Edge cases: null and empty texts have no words; a null id counts as the empty string in the checksum; texts of
any length are read in pieces; repeated rows count again; an empty table gives an empty result. Ties of
occurrences go to the smaller word in code-point order. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, durable, hot_join, worker_state
from .prefix_trie import CRC_TABLE, crc_sql

#: Runs of [a-z] and U+00C0 to U+00FF in UTF-8, once capital A-Z are small; C3 only ever leads a letter.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One run of so many has a code point deleted.
ODD = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: Bytes that the words a task holds are charged, and bytes of a text that are searched at a time.
HELD, PIECE = 32 << 20, 1 << 20
#: Primes and bases of the two rolling hashes (fixed values).
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)
#: Leading bits of a key that choose its partition.
RADIX_BITS = 12


def _deleted(run: bytes, prefix: int) -> bytes:
    """The run, or for one of ODD without the code point that the checksum (after the id's) points at."""
    h = zlib.crc32(run, prefix)
    if h % ODD:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _runs(low: bytes) -> Iterator[list[bytes]]:
    """The runs of a lower-cased text, piece by piece; a piece ends where no run goes on."""
    at = 0
    while at < len(low):
        end = min(len(low), at + PIECE)
        if end < len(low):
            # The last separator of the piece, or the end of the run that goes beyond it.
            open_run = RUN.match(low, end) if low[end - 1] != 0xC3 else None
            if low[end - 1] == 0xC3:
                end += 1
                open_run = RUN.match(low, end)
            end = open_run.end() if open_run else end
        yield RUN.findall(low, at, end)
        at = end


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state(("spelling",), dict)  # nothing of its own; what an earlier operator kept goes
    held: dict[bytes, int] = {}
    charged = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py()
            if not text:
                continue
            prefix = zlib.crc32(("" if i is None else str(i)).encode() + b":")
            for runs in _runs(text.encode("utf-8", "surrogatepass").lower()):
                for run, n in Counter(runs).items():
                    word = _deleted(run, prefix)
                    if len(word) - word.count(b"\xc3") >= LEAST_LETTERS:
                        if word not in held:
                            charged += 140 + len(word)
                        held[word] = held.get(word, 0) + n
                if charged > HELD:
                    yield out()
                    held.clear()
                    charged = 0
    yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with LEAST_COUNT occurrences."""
    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_count_batches, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo prime, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


def _mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64 well-spread bits of a hash and a salt."""
    x = h ^ (salt * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's index, kind) of all keys; kind 0: a replacement's, 1: a deletion's, 2: the whole word's."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    index = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[index]
    whole, deleted = np.zeros(len(words), np.uint64), np.zeros(len(points), np.uint64)
    for base, prime in zip(BASES, PRIMES, strict=True):
        p = np.uint64(prime)
        terms = (points + np.uint64(1)) * _powers(base, prime, int(lengths.max(initial=0)))[place] % p
        # Sums of terms below 2^31: a batch of 2^32 code points would still fit.
        upto = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        first, last = upto[starts], upto[starts + lengths]
        prefix, suffix = upto[:-1] - first[index], last[index] - upto[1:]
        inverse = np.uint64(pow(base, -1, prime))
        whole = (whole << np.uint64(31)) | ((last - first) % p)
        deleted = (deleted << np.uint64(31)) | ((prefix % p + suffix % p * inverse % p) % p)
    size = lengths.astype(np.uint64)
    same = np.zeros(len(points), bool)
    same[1:] = (points[1:] == points[:-1]) & (index[1:] == index[:-1])
    once = np.flatnonzero(~same)
    # Salts tell kinds, lengths and places apart; those of whole words are the shorter length alone.
    replaced = _mixed(deleted, (size[index] << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
    shorter = _mixed(deleted[once], size[index[once]] - np.uint64(1) << np.uint64(32))
    key = np.concatenate([replaced, shorter, _mixed(whole, size << np.uint64(32))])
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(points), len(once), len(words)])
    return key, np.concatenate([index, index[once], np.arange(len(words))]), kind


#: Code points whose keys are made at a time.
POINTS = 1 << 18


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ids: list[int], words: list[str]) -> pa.RecordBatch:
        key, index, kind = keys_of(words)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array(ids, np.int64)[index]), pa.array(kind)], names=["key", "id", "kind"])

    for batch in batches:
        ids, words, held = [], [], 0
        for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            words.append(w)
            held += len(w)
            if held > POINTS:
                yield out(ids, words)
                ids, words, held = [], [], 0
        if ids:
            yield out(ids, words)


#: Pairs that a batch of candidates holds.
PAIRS = 100_000


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by key: of equal keys, every pair of replacements, every whole word with every deletion."""

    def groups() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, kind = (c.to_numpy() for c in batch.columns)
            parts.append((key, ids, kind))
            if key[0] == key[-1]:
                continue
            key, ids, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
            # Keys of one row have no pair; the last key may go on.
            cut = int(np.searchsorted(key, key[-1]))
            yield from cut_groups(key[:cut], ids[:cut], kind[:cut])
            parts = [(key[cut:], ids[cut:], kind[cut:])]
        if parts:
            yield from cut_groups(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def cut_groups(key: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(key):
            return
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for k in np.flatnonzero(np.diff(bounds) > 1):
            yield ids[bounds[k] : bounds[k + 1]], kind[bounds[k] : bounds[k + 1]]

    def out(a: list, b: list) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    a, b, held = [], [], 0
    for ids, kind in groups():
        replaced, shorter, whole = (ids[kind == k] for k in range(3))
        for k in range(len(replaced) - 1):
            a.append(np.full(len(replaced) - k - 1, replaced[k]))
            b.append(replaced[k + 1 :])
            held += len(replaced) - k - 1
        for w in whole:
            a.append(np.full(len(shorter), w))
            b.append(shorter)
            held += len(shorter)
        if held > PAIRS:
            yield out(a, b)
            a, b, held = [], [], 0
    yield out(a, b)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells two words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # the first difference, by halving
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if a[lo : mid + 1] == b[lo : mid + 1] else (lo, mid)
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [one_apart(x, y) for x, y in zip(batch.column("a_word").to_pylist(), batch.column("b_word").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def neighbours(words: DataFrame) -> DataFrame:
    """(a_word, a_n, b_word, b_n) of the near pairs of a vocabulary (id, word, n), each once."""
    keys = words.select("id", "word").mapInArrow(_key_batches, "key long, id long, kind tinyint")
    radix = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    pairs = radix.mapInArrow(_pair_batches, "a long, b long")
    side = lambda s: words.select(F.col("id").alias(s), F.col("word").alias(f"{s}_word"), F.col("n").alias(f"{s}_n"))
    named = pairs.join(side("a"), "a").join(side("b"), "b").select("a_word", "a_n", "b_word", "b_n")
    return named.mapInArrow(_verify_batches, named.schema)


def _roots(forms: DataFrame, rows: int) -> DataFrame:
    """(word, root) from (word, form): pointers that double until none moves."""
    at = durable(forms.select("word", F.col("form").alias("root")), rows)
    while True:
        fan = at.groupBy("root").agg(F.count("*").alias("n"))
        table = at.select(F.col("word").alias("root"), F.col("root").alias("next")).join(fan, "root")
        moved = durable(hot_join(at, table, "root", "n", max(1, rows)), rows)
        if moved.where("next is not null").isEmpty():
            return at
        at = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form (the near word of most occurrences, if RATIO times the word's), root (the last
    of the chain of forms), n, n_near, form_n."""
    words = durable(compact(vocabulary(docs, id_col, text_col), docs).withColumn("id", F.monotonically_increasing_id()))
    rows = words.count()
    pairs = durable(neighbours(words))
    way = lambda a, b: pairs.select(F.col(f"{a}_word").alias("word"), F.col(f"{a}_n").alias("own"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(f"{b}_word").alias("word")).alias("near"))
    near = way("a", "b").unionByName(way("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    big = (-F.col("best.less")) >= RATIO * F.col("n")
    met = words.select("word", "n").join(near, "word", "left").withColumn("form", F.when(big, F.col("best.word"))).withColumn("form_n", F.when(big, -F.col("best.less")))
    found = durable(met.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), rows)
    roots = _roots(found.where("form is not null").select("word", "form"), rows)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows from DuckDB.
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT id, run, COUNT(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM d) GROUP BY id, run),
c AS (SELECT run, n, {crc_sql("(id || ':' || run)")} AS h FROM r, crc_table),
w AS (SELECT word, SUM(n) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c) WHERE length(word) >= 5 GROUP BY word HAVING SUM(n) >= 3),
k AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM w), x AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS s FROM k),
p AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.s = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.s = w.word),
m AS (SELECT a, COUNT(*) AS n_near, MAX(bn) AS top FROM p GROUP BY a), f AS (SELECT m.a, n_near, top, MIN(p.b) AS best FROM m JOIN p ON m.a = p.a AND p.bn = m.top GROUP BY m.a, n_near, top),
v AS (SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN f ON w.word = f.a),
z AS (SELECT word, word AS tail, 0 AS steps FROM v UNION ALL SELECT z.word, v.form, steps + 1 FROM z JOIN v ON z.tail = v.word WHERE v.form IS NOT NULL),
l AS (SELECT word, ARG_MAX(tail, steps) AS root FROM z GROUP BY word)
SELECT v.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM v JOIN l ON v.word = l.word"""
