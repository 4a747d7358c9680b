"""SimHash near-duplicates: exact search within a Hamming radius by bit-sliced comparison.

Plan: one Arrow pass turns each whole text into a 64-bit fingerprint; everything after works on
distinct fingerprints (8 bytes each). Fingerprints at most 3 bits apart agree on at least two of
five bit blocks, so every pair meets under one of ten block-pair keys. Keys with one fingerprint
are dropped by an aggregate; the fingerprints of a key are compared bit-sliced, and each key yields
a spanning forest, never its pairs. Keys with more than HOT fingerprints are keyed anew by the bits that
the key leaves open, which again fall into five blocks of which two are equal, LEVELS times at most;
what is still larger has at most 2^15 different fingerprints and is compared in pairs of chunks. So no
key is one task's work and no pair is lost. Components come from alternating star contraction, cut by
checkpoints; hubs and frequent fingerprints meet a broadcast table (common.hot_join).

Edge cases: a null or wordless text has fingerprint zero and links like any other; one or two words
form one shingle; equal texts share a fingerprint; an empty table gives an empty result; other
columns of the input are ignored, whatever their names. Null ids never become a component id unless
the whole component has none. Repeated ids are rows of their own; very long texts are hashed in parts.
Ties between rows that keep_one could keep go to the least id (null last), then the least text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, durable, hot_join, worker_state

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bits of the five blocks, by level: of the fingerprint, then of what a level's key leaves open.
WIDTHS = ((13, 13, 13, 13, 12), (8, 8, 8, 8, 7), (5, 5, 5, 5, 4))
LEVELS = len(WIDTHS)
#: Fingerprints under one key that one task compares; keys with more go to the next level.
HOT = 2048
#: Lanes of a block of bit planes.
LANES = 4096
_FULL = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = xxhash.xxh64_intdigest(joined, SEED)
        return h
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[SHINGLE - 1 :]
    digest, n = xxhash.xxh64_intdigest, len(ends)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _FULL):  # bounded scratch memory for very long texts
        part = zip(starts[lo : lo + _FULL].tolist(), ends[lo : lo + _FULL].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state(("simhash",), dict)  # nothing of its own; what an earlier operator kept goes
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["id", "fp", "hash"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, hash): one row per input row, fp as a signed long; hash is that of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return rows.mapInArrow(_fingerprint_batches, f"id {kind}, fp long, hash long")


def _planes(prints: np.ndarray) -> list[int]:
    """Vertical form: plane b holds bit b of every fingerprint, one lane each."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _within(query: int, planes: list[int], full: int, active: int) -> int:
    """Active lanes at most RADIUS (3) bits from the query: carry-save counters over the planes,
    left as soon as every active lane has overflowed the radius."""
    ones = twos = over = 0
    for b, plane in enumerate(planes):
        x = plane ^ full if query >> b & 1 else plane
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if b & 3 == 3 and not active & ~over:
            return 0
    return active & ~over


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of distinct fingerprints under the radius. A lane leaves the
    active set once reached, so dense groups cost little more than one comparison per lane."""
    blocks = []
    for lo in range(0, len(prints), LANES):
        part = prints[lo : lo + LANES]
        full = (1 << len(part)) - 1
        blocks.append([_planes(part), full, full, part.tolist()])
    edges: list[tuple[int, int]] = []
    for block in blocks:
        while block[2]:
            lane = (block[2] & -block[2]).bit_length() - 1
            block[2] &= block[2] - 1
            todo = [block[3][lane]]
            while todo:
                query = todo.pop()
                for other in blocks:
                    if not other[2]:
                        continue
                    near = _within(query, other[0], other[1], other[2])
                    other[2] &= ~near
                    while near:
                        found = other[3][(near & -near).bit_length() - 1]
                        near &= near - 1
                        edges.append((query, found))
                        todo.append(found)
    return edges


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by all columns but the last, the fingerprint; a group may run over batches."""

    def flush(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        prints = np.unique(np.concatenate(parts))
        return forest(prints) if len(prints) > 1 else []

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        e = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])

    last, held, edges = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1)
        prints = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(prints)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (now := tuple(group[a])) != last and held:
                edges += flush(held)
                held = []
            last = now
            held.append(prints[a:b])
            if len(edges) > 50_000:
                yield out(edges)
                edges = []
    if held:
        edges += flush(held)
    yield out(edges)


def _keys(bits: F.Column, level: int) -> list[F.Column]:
    """Structs (key, open) of the ten block pairs: the pair's number and bits, and the bits left open."""
    widths, blocks, at = WIDTHS[level], [], 0
    for w in widths:
        blocks.append(F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    out = []
    for k, (i, j) in enumerate((i, j) for i in range(len(widths)) for j in range(i)):
        left, at = F.lit(0).cast("long"), 0
        for b in range(len(widths)):
            if b not in (i, j):
                left, at = left + F.shiftleft(blocks[b], at), at + widths[b]
        out.append(F.struct((F.lit(k << 40) + F.shiftleft(blocks[i], 16) + blocks[j]).alias("key"), left.alias("open")))
    return out


def links(prints: DataFrame) -> DataFrame:
    """(u, v): forest edges among distinct fingerprints (column fp), in all keys together."""
    rows, found, names, n_rows = prints.select("fp", F.col("fp").alias("open")), None, [], prints.count()
    for level in range(LEVELS):
        keys = F.explode(F.array(*_keys(F.col("open"), level))).alias("k")
        rows = rows.select("fp", *names, keys).select("fp", *names, F.col("k.key").alias(f"key{level}"), F.col("k.open").alias("open"))
        names.append(f"key{level}")
        # Sizes are counted by the fingerprints' keys alone, rows of frequent keys meet a broadcast table; keys of one
        # fingerprint have no pair.
        n_rows *= 10
        key = F.struct(*names).alias("key")
        sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n"))
        met = durable(hot_join(rows.withColumn("key", key), sizes, "key", "rows", n_rows).where("n > 1").drop("key"), n_rows)
        hot = met.where(F.col("n") > HOT)
        n_rows = 0 if level == LEVELS - 1 else hot.count()
        last = not n_rows
        small = _dealt(met if last else met.where(F.col("n") <= HOT), names)
        found = small if found is None else found.unionAll(small)
        if last:
            return found
        rows = hot.drop("n")


def _dealt(met: DataFrame, names: list[str]) -> DataFrame:
    """Edges of the fingerprints under each key; a key above HOT in pairs of chunks."""
    parts = F.ceil(F.col("n") / HOT).cast("int")
    cut = met.withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = [*names, "i", "j"]
    rows = paired.select(*names, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_forest_batches, "u long, v long")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): root is the least node of the component. Alternating large-star and small-star
    contraction; each round ends in a checkpoint and is compared by count and hash alone. rows: a bound on
    the edges, if known."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    seen = mark(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both, least, "u", "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, "u", "n", 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), 2 * seen[0])
        before, seen = seen, mark(e)
        if before == seen:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, hash, root, component_id) of every row; root is the least fingerprint of the component."""
    prints = durable(compact(fingerprints(docs, id_col, text_col), docs))
    total = prints.count()
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), total)
    found = components(links(distinct), 10 * total)
    linked = found.unionAll(found.select("root", "root")).distinct().withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    classes = durable(hot_join(rooted, low, "root", "prints", total).select("fp", "root", "component_id", "n"), total)
    return hot_join(prints, classes, "fp", "n", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id."""
    found = _classes(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with one row of each component: the one with the least id (null
    last), of repeated ids the one with the least text hash. Repeated rows become one."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    keep = _classes(docs, id_col, text_col).groupBy("root").agg(first.alias("r")).select(F.col("r.none").alias("__none"), F.coalesce(F.col("r.id").cast("string"), F.lit("")).alias("__id"), F.col("r.hash").alias("__hash"))
    key = ["__none", "__id", "__hash"]
    named = docs.withColumns({"__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__hash": F.xxhash64(text_col)})
    # Repeated rows go first, by a partial aggregate, so that none of them is hot in the join.
    return compact(named.dropDuplicates(key).join(keep, key, "left_semi").select(*docs.columns), docs)
