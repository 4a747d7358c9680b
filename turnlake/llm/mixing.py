"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources share the whole size by weight; a source stops at CAP times its own size and
the excess is shared anew by weight. A source is taken in whole passes, plus a part of it for the
rest. Its documents fall into blocks by a seeded hash; the part is a prefix of the blocks in a seeded
permutation; in the block where the quota ends each document, in the order of a second hash, is taken
if it still fits, so what is missing in the end is less than any document left out there.

Output shards: every source has an exact quota of blocks (passes times blocks, plus the part). A tree
over the shards splits all quotas in two at each node, drawing how many blocks of each source go left
from the multivariate hypergeometric distribution, so every shard gets its number of blocks and the
draws of all shards are disjoint. Inside a shard rows are shuffled by a seeded hash.

Scale: one pass sums sizes by (source, block), partial sums first, so a source with a third of all
rows is many small groups. A source has blocks in proportion to its documents, ALL_BLOCKS in all and one a
source at least: the driver holds one row per source and per block, whatever the corpus. The block where a
quota ends is cut again by a second hash, until BLOCK documents are left; these alone are put in order.
A shard is put in order in slices of its hash range, SLICE documents each, so no task holds a shard.

Edge cases: null texts have size 0; null is a source of its own, last; a source without words is
never taken and has target 0; equal texts and repeated rows and ids count each, as rows of their own; an
empty table gives an empty result; very long texts count like others, as one document; other columns stay
out of the digest and are carried by apply(). Ties of a hash go by size, then id. All choices are seeded
hashes of id and text, so reruns agree; exact repeats of a row (both equal) stand together in a shard.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, durable, small_table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20_077
#: Documents of a block, about.
BLOCK = 256
#: Blocks of all sources together, about, and most cells that a descent into one block looks at.
ALL_BLOCKS, BINS = 1 << 16, 4096
#: Documents of a slice of a shard's order, about.
SLICE = 1 << 17
#: Least shards, and blocks of one beyond that, so that a shard, which one task puts in order, does not grow with the data.
SHARDS = 16
SHARD_BLOCKS = 4
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[Fraction]:
    """Shares of the whole by weight, none above cap times its own size; the excess reshared."""
    total, full = sum(sizes), set()
    free = set(range(len(sizes)))
    while free:
        rest = total - sum(cap * sizes[i] for i in full)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if Fraction(rest * weights[i], weight) > cap * sizes[i]}
        if not over:
            return [Fraction(cap * sizes[i]) if i in full else Fraction(rest * weights[i], weight) for i in range(len(sizes))]
        full |= over
        free -= over
    return [Fraction(cap * s) for s in sizes]


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): block counts of each shard; columns sum to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = total * (mid - lo) // (hi - lo)
        go = rng.multivariate_hypergeometric(have, left, method="marginals") if total else have
        node(go, lo, mid)
        node(have - go, mid, hi)

    node(np.asarray(quotas, np.int64), 0, shards)
    return out


def _bounded(table: DataFrame, rows: int) -> DataFrame:
    """Tables by block are broadcast while there are about ALL_BLOCKS blocks; more come of many sources
    only, and are then left to the join."""
    return F.broadcast(table) if rows <= 2 * CAP * ALL_BLOCKS else table


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *carried: F.Column) -> DataFrame:
    return docs.select(
        *carried,
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text_col).alias("hash"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
    )


def _inside(spark, rows: DataFrame, open_blocks: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Where the quota of each open block (number, block, quota, documents) ends: number -> (lo, hi,
    quota left). Documents whose second hash is below lo are taken; the quota ends among those in
    [lo, hi), which are BLOCK at most unless one hash has more."""
    state = {i: (b, 0, 1 << 62, quota) for i, b, quota, _ in open_blocks}
    todo = {i for i, _, _, n in open_blocks if n > BLOCK}
    kind = pa.schema([("number", pa.int32()), ("block", pa.int32()), ("lo", pa.int64()), ("width", pa.int64())])
    while todo:
        ranges = [(i, state[i][0], state[i][1], max(1, -(-(state[i][2] - state[i][1]) // BINS))) for i in sorted(todo)]
        cells = (
            rows.join(small_table(spark, ranges, kind), ["number", "block"])
            .withColumn("bin", F.expr("(within - lo) div width"))
            .where(f"within >= lo and bin < {BINS}")
            .groupBy("number", "bin")
            .agg(F.sum("size").alias("s"), F.count("*").alias("n"))
            .collect()
        )
        by: dict[int, list] = {i: [] for i in todo}
        for c in cells:
            by[c.number].append((c.bin, c.s, c.n))
        for i, _, lo, width in ranges:
            block, _, hi, quota = state[i]
            at, to, n_end = hi, hi, 0
            for bin_, s, n in sorted(by[i]):
                if n_end:  # the cells that follow, as long as they are few documents
                    if n_end + n > BLOCK:
                        break
                    n_end, to = n_end + n, lo + (bin_ + 1) * width
                elif s > quota:
                    at, to, n_end = lo + bin_ * width, lo + (bin_ + 1) * width, n
                else:
                    quota -= s
            state[i] = (block, at, min(hi, to), quota)
            if n_end <= BLOCK or width == 1:
                todo.discard(i)
    return {i: (lo, hi, quota) for i, (_, lo, hi, quota) in state.items()}


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, shards: int | None = None, seed: int = SEED, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, draws). documents: id, source, size, block, source_size, target, copies, taken, and with
    carry the whole input row as row. draws: one row per block and pass: number (of the source), block,
    pass, shard, slices (in which the shard is put in order). Without a number of shards, each has about
    SHARD_BLOCKS blocks."""
    spark = docs.sparkSession
    sized = durable(compact(_sized(docs, id_col, text_col, source_col), docs))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.size for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    every = sum(r.n for r in found)
    parts = [max(1, min(-(-r.n // BLOCK), ALL_BLOCKS * r.n // every)) for r in found]
    kind = pa.schema([("number", pa.int32()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("parts", pa.int32())])
    sources = small_table(spark, [(i, r.source, r.size, float(goal[i]), parts[i]) for i, r in enumerate(found)], kind)

    def placed(sized: DataFrame) -> DataFrame:
        # By id and text, so that null or repeated ids are many blocks.
        block = F.pmod(F.xxhash64("id", "hash", F.lit(seed)), F.col("parts")).cast("int").alias("block")
        within = F.shiftrightunsigned(F.xxhash64("id", "hash", F.lit(seed + 1)), 2).alias("within")
        return sized.join(sources, sized.source.eqNullSafe(sources.source)).select(*(sized[c] for c in sized.columns), "number", "source_size", "target", block, within)

    rows = placed(sized)
    sums: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in range(len(found))}
    for r in rows.groupBy("number", "block").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():
        sums[r.number][r.block] = (r.s, r.n)
    base, ends, drawn = [], [], []
    for i in range(len(found)):
        passes = int(goal[i] // sizes[i]) if sizes[i] else 0
        rest = round(goal[i] - passes * sizes[i])
        order = np.random.default_rng([seed, i]).permutation(parts[i]).tolist()
        taken, end = [], None
        for b in order:
            s = sums[i].get(b, (0, 0))[0]
            if s > rest:
                end = b
                break
            rest -= s
            taken.append(b)
        if end is not None and rest:
            ends.append((i, end, rest, sums[i][end][1]))
            taken.append(end)
        chosen = set(taken)
        base += [(i, b, passes, b in chosen) for b in range(parts[i])]
        drawn.append([(b, p) for p in range(passes) for b in order] + [(b, passes) for b in taken])
    cuts = _inside(spark, rows, ends)
    kind = pa.schema([("number", pa.int32()), ("block", pa.int32()), ("passes", pa.int32()), ("more", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64()), ("quota", pa.int64())])
    at_end = {(i, b): cuts[i] for i, b, _, _ in ends}
    table = _bounded(small_table(spark, [(*x, *at_end.get(x[:2], (1 << 62, 1 << 62, 0))) for x in base], kind), len(base))
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    dealt = (placed(_sized(docs, id_col, text_col, source_col, whole)) if carry else rows).join(table, ["number", "block"])
    # The documents around the ends of the quotas; kept, as their partitions number them.
    last = durable(compact(dealt.where("within >= lo and within < hi and quota > 0").withColumn("part", F.spark_partition_id()), docs))
    group = ["number", "id", "within", "size"]
    # Repeated rows (same id and text) are one entry with a count: as many are taken as still fit.
    fold = (
        "aggregate(docs, named_struct('left', quota, 'times', cast(array() as array<bigint>)), (a, x) ->"
        " named_struct('left', a.left + x.less * if(x.less < 0, least(x.n, a.left div -x.less), 0), 'times', array_append(a.times, if(x.less < 0, least(x.n, a.left div -x.less), 0L)))).times"
    )
    met = last.groupBy(*group, "quota").agg(F.count("*").alias("n")).groupBy("number", "quota").agg(F.sort_array(F.collect_list(F.struct("within", (-F.col("size")).alias("less"), "id", "n"))).alias("docs"))
    taken = met.select("number", F.explode(F.arrays_zip("docs", F.expr(fold).alias("times"))).alias("x")).where("x.times > 0")
    chosen = taken.select(F.col("number").alias("c_number"), F.col("x.docs.id").alias("c_id"), F.col("x.docs.within").alias("c_within"), (-F.col("x.docs.less")).alias("c_size"), F.col("x.times").alias("times"))
    # They are told apart by a running number, counted by partition so that none of them is one task's work.
    parted = last.groupBy(*group, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parted.select(*(F.col(c).alias(f"b_{c}") for c in (*group, "part")), F.coalesce(before, F.lit(0)).alias("base"))
    same = lambda a, names: F.expr(" and ".join(f"{n} <=> {a}_{n}" for n in names))
    numbered = last.withColumn("inside", F.row_number().over(Window.partitionBy(*group, "part").orderBy("block"))).join(bases, same("b", [*group, "part"]))
    filled = numbered.join(chosen, same("c", group), "left")
    columns = ["id", "source", "size", "number", "block", "within", "source_size", "target", *(["row"] if carry else [])]
    ended = filled.select(*columns, (F.col("passes") + F.when(F.col("base") + F.col("inside") <= F.col("times"), 1).otherwise(0)).alias("copies"))
    rest = dealt.where("not (within >= lo and within < hi and quota > 0)").select(*columns, (F.col("passes") + F.when(F.col("more") & (F.col("within") < F.col("lo")), 1).otherwise(0)).alias("copies"))
    documents = rest.unionByName(ended).withColumn("taken", F.col("size") * F.col("copies"))
    shards = shards or max(SHARDS, sum(map(len, drawn)) // SHARD_BLOCKS)
    counts = split_tree(np.array([len(d) for d in drawn], np.int64), shards, seed)
    draws, held = [], [0] * shards
    for i, d in enumerate(drawn):
        at = 0
        for s in range(shards):
            for b, p in d[at : at + int(counts[s, i])]:
                draws.append((i, b, p, s))
                held[s] += sums[i].get(b, (0, 0))[1]
            at += int(counts[s, i])
    kind = pa.schema([("number", pa.int32()), ("block", pa.int32()), ("pass", pa.int32()), ("shard", pa.int32()), ("slices", pa.int32())])
    return documents, _bounded(small_table(spark, [(*d, -(-held[d[3]] // SLICE)) for d in draws], kind), len(draws))


def _drawn(rows: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """The rows taken, once per pass, with pass, shard, slice and order: shards are read by slice, slices by
    order."""
    copies = rows.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    drawn = copies.join(draws, ["number", "block", "pass"]).withColumn("order", F.xxhash64("id", "within", "pass", F.lit(seed + 2)))
    # A slice is a range of the order: its upper 31 bits by the number of slices.
    return drawn.withColumn("slice", F.expr("cast((shiftright(order, 33) + 1073741824) * slices div 2147483648 as int)")).drop("slices")


def _placed(rows: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """The rows taken, once per pass, with pass, shard and position."""
    drawn = _drawn(rows, draws, seed)
    sizes = drawn.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("order", "id", "pass"))
    numbered = drawn.withColumn("inside", inside).join(bases, ["shard", "slice"])
    return numbered.withColumn("position", (F.col("base") + F.col("inside")).cast("int")).drop("slice", "order", "inside", "base")


def digest(docs: DataFrame, seed: int = SEED, **names) -> DataFrame:
    """Per input row: id, size, source_size, target, taken (words, repeats counted), copies, and the
    shards and positions of its draws by pass."""
    rows, draws = plan(docs, seed=seed, **names)
    columns = ["id", "size", "source_size", "target"]
    # Equal rows count each, so draws are summed by a number of the row and not by its id; kept, as it is read twice.
    rows = durable(compact(rows.select(*columns, "number", "block", "within", "copies", F.monotonically_increasing_id().alias("row")), docs))
    drawn = _placed(rows, draws, seed).groupBy("row", *columns)
    places = F.sort_array(F.collect_list(F.struct("pass", "shard", "position")))
    summed = drawn.agg(F.sum("size").alias("taken"), F.count("*").cast("int").alias("copies"), places.alias("p")).select(*columns, "taken", "copies", F.col("p.shard").alias("shards"), F.col("p.position").alias("positions"))
    nothing = F.array().cast("array<int>")
    left = rows.where("copies = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), nothing.alias("shards"), nothing.alias("positions"))
    return summed.unionByName(left).withColumnRenamed("id", names.get("id_col", "doc_id"))


def mix(docs: DataFrame, seed: int = SEED, **names) -> DataFrame:
    """The mix itself: (id, number, pass, shard, position): one row per document taken, in shuffled
    order inside its shard."""
    return _placed(*plan(docs, seed=seed, **names), seed).select("id", "number", "pass", "shard", "position")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix with the input's columns: one row per draw, dealt out by (shard, slice) and in drawn order
    inside each, so a partition holds whole slices."""
    drawn = _drawn(*plan(docs, id_col, text_col, source_col, seed=seed, carry=True), seed)
    dealt = drawn.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "order", "id", "pass")
    return compact(dealt.select(*(F.col("row")[c].alias(c) for c in docs.columns)), docs)
