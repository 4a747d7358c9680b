"""Prefix trie of conversations with subtree sums by heavy-path decomposition.

A conversation's turns stand in order of turn (null first; equal ones by the digest of role and text). Its
rebuilt form takes the first turns of its family's first conversation, then its own (rebuilt()). Nodes of the
trie are the different prefixes, named by their depth and 128 bits: two 64-bit hashes of (place, turn digest),
joined by exclusive or along the conversation, so that a prefix needs no fold in one task.

Subtree sums: of a node's children the one with most members (then the largest least member) is heavy, all
others, and all nodes of depth 1, are light. A path starts at a light node and follows heavy ones to a leaf, so
it is a stretch of any conversation that ends there, and one join per node finds it. A light node has at most
half its parent's members, so no node has more light ones above it than the binary logarithm of the
conversations; that many rounds add the sums of paths, deepest first, to the nodes they hang from. Then sums
run from the end of every path to its start.

Nothing is one task's: orders are range partitions with counts before them, running values go by stretches
of STRETCH places with the stretches before (or behind) added, hot conversations, nodes and parents meet
broadcast tables of bounded size (common.hot_join), ids that end at one node are joined by ranges of ids and
hashed as a stream. The driver holds counts; every round ends in a checkpoint.

Edge cases: null roles and texts are empty; rows without conv_id belong to no conversation; a null turn comes
first; repeated rows are turns of their own; a conversation without turns of its own (after the family's) is
rebuilt from the family's, or ends at the root; an empty table has no node, not even the root. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, hot_join

FAMILY, SHARED = 5, 9
#: Places of a conversation or path that one window holds.
STRETCH = 4096
#: Conversations in a range of ids.
RANGE = 100_000
_ROW_BITS = 33


def _xor(column: str) -> Column:
    return F.expr(f"bit_xor({column})")


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row among those of its key. Partitions are ranges of key and order, so a key of
    any size is spread; a place is the key's rows in the ranges before and those before it in its own."""
    ranged = durable(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__m", _ROW_BITS))
    sizes = ranged.groupBy(key, "__part").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    # One row a key and partition.
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("__base", before).drop("__n")
    return ranged.join(bases, [key, "__part"]).withColumn("pos", F.col("__m") - F.col("__first") + F.col("__base")).drop("__m", "__part", "__first", "__base")


def running(rows: DataFrame, key: str, place: str, values: dict[str, str], fold, last_first: bool = False) -> DataFrame:
    """Adds for each value (name: column) the fold of the key's rows up to and with a row's, in order of place or,
    last_first, from the end. Windows hold STRETCH places; the folds of whole stretches are added to them."""
    cut = rows.withColumn("__s", F.floor(F.col(place) / STRETCH))
    sort = (lambda c: F.desc(c)) if last_first else (lambda c: F.asc(c))
    inside = Window.partitionBy(key, "__s").orderBy(sort(place)).rowsBetween(Window.unboundedPreceding, 0)
    outside = Window.partitionBy(key).orderBy(sort("__s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "__s").agg(*(fold(c).alias(f"__t_{n}") for n, c in values.items()))
    bases = totals.select(key, "__s", *(fold(f"__t_{n}").over(outside).alias(f"__b_{n}") for n in values))
    joined = cut.withColumns({n: fold(c).over(inside) for n, c in values.items()}).join(bases, [key, "__s"])
    both = F.array
    whole = {n: F.aggregate(both(F.col(n), F.coalesce(F.col(f"__b_{n}"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x) if fold is _xor else a + x) for n in values}
    return joined.withColumns(whole).drop("__s", *(f"__b_{n}" for n in values))


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (c, idx from 0, digest, bytes) and the conversations (c, len). Of h, the
    checksum of its decimal id modulo SHARED, conversation c takes the first h original turns of conversation
    c - c % FAMILY (all if fewer, none if absent), then its own after the first h."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(plain(role)).cast("string"), F.lit(":"), plain(role), plain(text)).cast("binary"))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(plain(text)).cast("long").alias("bytes"))
    own = durable(placed(rows, "c", ["turn", "digest"]).drop("turn"))
    base = F.col("c") - F.col("c") % FAMILY
    h = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED
    sizes = durable(own.groupBy("c").agg(F.count("*").alias("n")))
    convs = sizes.withColumn("base", base).withColumn("h", h).join(sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    # A family is ten conversations at most (around zero), of at most SHARED turns of the first.
    convs = durable(convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))
    late = own.where(F.col("pos") >= h)
    total = own.count()
    kept = hot_join(late, convs.select("c", "n", "taken", "h"), "c", "n", total).select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("idx"), "digest", "bytes")
    heads = own.where((F.col("pos") < SHARED) & (base == F.col("c"))).withColumnRenamed("c", "base")
    lent = heads.join(convs.select("c", "base", "taken"), "base").where("pos < taken").select("c", F.col("pos").alias("idx"), "digest", "bytes")
    return kept.unionByName(lent), convs.select("c", "len")


def _steps(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, key, parent, bytes, last) of every rebuilt turn; key and parent: struct<d, a, b> of the prefix with
    the turn and of that before it."""
    hashed = turns.withColumns({"ea": F.xxhash64("idx", "digest"), "eb": F.xxhash64("digest", F.lit(7), "idx")})
    summed = running(hashed, "c", "idx", {"a": "ea", "b": "eb"}, _xor)
    d = (F.col("idx") + 1).alias("d")
    key = F.struct(d, "a", "b").alias("key")
    parent = F.struct(F.col("idx").alias("d"), F.col("a").bitwiseXOR(F.col("ea")).alias("a"), F.col("b").bitwiseXOR(F.col("eb")).alias("b")).alias("parent")
    return summed.select("c", d, key, parent, "bytes")


def _ends(steps: DataFrame, convs: DataFrame, n: int) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end: ids joined by ranges, hashed as a stream."""
    root = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    last = steps.join(convs, [steps.c == convs.c, steps.d == convs.len]).select(steps.c, "key")
    at = last.unionByName(convs.where("len = 0").select("c", root.alias("key")))
    ranged = durable(at.repartitionByRange(max(1, -(-n // RANGE)), "c").withColumn("part", F.spark_partition_id()))
    joined = ranged.groupBy("key", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    flat = joined.select("key.d", "key.a", "key.b", "part", "ids").repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple]) -> pa.RecordBatch:
            d, a, b, sha = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], names=["d", "a", "b", "ends_sha256"])

        now, digest, done = None, None, []
        for batch in batches:
            for d, a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (d, a, b) == now:
                    digest.update(b",")
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (d, a, b), hashlib.sha256()
                digest.update(ids.encode())
            if len(done) > 10_000:
                yield out(done)
                done = []
        if now:
            yield out([*done, (*now, digest.hexdigest())])

    hashed = flat.mapInArrow(run, "d long, a long, b long, ends_sha256 string")
    return hashed.select(F.struct("d", "a", "b").alias("key"), "ends_sha256")


def _marked(steps: DataFrame, total: int) -> DataFrame:
    """Nodes below the root: key, parent, d, n_convs, conv_id, n_children, parent_conv_id (null below the root),
    w (the node's own saved tokens), leaf, light."""
    nodes = durable(steps.groupBy("key").agg(F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.min("bytes").alias("bytes")))
    order = F.struct("n_convs", "conv_id", "key")
    kids = nodes.where("key.d > 1").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.max(order).alias("heavy"))
    known = durable(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    above = known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.key").alias("heavy_key"), F.col("n_children").alias("n"))
    met = hot_join(known.drop("heavy"), above, "parent", "n", total)
    light = F.col("heavy_key").isNull() | (F.col("heavy_key") != F.col("key"))
    return met.select("key", "parent", "n_convs", "conv_id", "n_children", "parent_conv_id", ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"), (F.col("n_children") == 0).cast("long").alias("leaf"), light.alias("light"))


def _paths(steps: DataFrame, nodes: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Every node with its path (the least id that ends at the path's leaf), and the paths: path, top, rank (how
    many light nodes lead to it), parent (of its top)."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("c"), F.col("key.d").alias("n"), F.lit(True).alias("mine"))
    chain = hot_join(steps.select("c", "d", "key"), leaves, "c", "n", total).where("mine").drop("mine")
    info = nodes.withColumn("n", F.col("n_convs"))
    full = durable(hot_join(chain, info, "key", "n", total))
    tops = full.groupBy("c").agg(F.max(F.when(F.col("light"), F.struct("d", "parent"))).alias("t"), F.count(F.when(F.col("light"), 1)).alias("rank"), F.count("*").alias("n"))
    tops = durable(tops.select("c", F.col("t.d").alias("top"), F.col("t.parent").alias("parent"), "rank", "n"))
    on = hot_join(full, tops.select("c", "top", "n"), "c", "n", total).where("d >= top").withColumnRenamed("c", "path").drop("top")
    return durable(on), tops.drop("n").withColumnRenamed("c", "path")


def _attached(on: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, d, more_w, more_leaves): sums of all light subtrees that hang from a path's nodes, by rounds over
    the paths, those below most light nodes first."""
    own = on.groupBy("path").agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaves"))
    below = paths.where("rank > 1")
    spots = on.where("n_children > 1").select(F.col("key").alias("parent"), F.col("path").alias("host"), F.col("n_children").alias("n"))
    n_paths = paths.count()
    hung = hot_join(below, spots, "parent", "n", max(1, n_paths)).select("path", "rank", "host", F.col("parent.d").alias("at"))
    left = durable(own.join(paths.where("rank = 1").select("path", "rank", F.lit(None).cast("long").alias("host"), F.lit(None).cast("long").alias("at")).unionByName(hung), "path"), n_paths)
    deepest = left.agg(F.max("rank")).first()[0] or 0
    whole, above = None, left.where(F.col("rank") == deepest)
    for rank in range(deepest, 1, -1):
        done = durable(above, n_paths)
        whole = done if whole is None else whole.unionByName(done)
        up = done.groupBy(F.col("host").alias("path")).agg(F.sum("w").alias("up_w"), F.sum("leaves").alias("up_leaves"))
        joined = left.where(F.col("rank") == rank - 1).join(up, "path", "left")
        above = joined.withColumn("w", F.col("w") + F.coalesce("up_w", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("up_leaves", F.lit(0))).drop("up_w", "up_leaves")
    if whole is None:
        whole = left.where("false")
    return whole.groupBy(F.col("host").alias("path"), F.col("at").alias("d")).agg(F.sum("w").alias("more_w"), F.sum("leaves").alias("more_leaves"))


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id (the least member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    told, convs = rebuilt(turns, conv, turn, role, text)
    convs = durable(convs)
    steps = durable(_steps(told, convs))
    total, n = steps.count(), convs.count()
    least = convs.agg(F.min("c")).first()[0]
    nodes = durable(_marked(steps, max(1, total)))
    on, paths = _paths(steps, nodes, max(1, total))
    summed = on.join(_attached(on, paths), ["path", "d"], "left")
    summed = summed.withColumn("w", F.col("w") + F.coalesce("more_w", F.lit(0))).withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).drop("more_w", "more_leaves")
    subtree = running(summed, "path", "d", {"saved_tokens": "w", "n_leaves": "leaf"}, F.sum, last_first=True)
    below = subtree.select("key", "conv_id", F.col("d").alias("depth"), F.coalesce("parent_conv_id", F.lit(least)).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    zero = F.lit(0).cast("long")
    # The root has all conversations and the sums of everything below it.
    below_root = nodes.agg(F.coalesce(F.sum("w"), zero).alias("saved_tokens"), F.greatest(F.lit(1).cast("long"), F.coalesce(F.sum("leaf"), zero)).alias("n_leaves"), F.count(F.when(F.col("key.d") == 1, 1)).alias("n_children"))
    root = below_root.select(F.struct(zero.alias("d"), zero.alias("a"), zero.alias("b")).alias("key"), F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    whole = below.unionByName(root.where(F.lit(n > 0)))
    out = whole.join(_ends(steps, convs, n), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: CRC-32 of a text in DuckDB: its table of 256 entries follows from the polynomial (a fixed value), then
#: one step a byte.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)"""


def crc_sql(text: str, table: str = "t") -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8; table: the column of CRC_TABLE."""
    each = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {each}), lambda x, y: xor({table}[CAST(xor(x, y) & 255 AS BIGINT) + 1], x >> 8)), 4294967295)"


#: The same rows from DuckDB; a node's subtree is found through the ancestors that its least member passes.
ORACLE = f"""WITH {CRC_TABLE},
o AS (SELECT conv_id AS c, md5(strlen(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS g, strlen(COALESCE(text, '')) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, g, bytes, ROW_NUMBER() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM o),
s AS (SELECT c, COUNT(*) AS n FROM o GROUP BY c),
h AS (SELECT s.c, s.n, {crc_sql("CAST(s.c AS VARCHAR)")} % 9 AS h, s.c - s.c % 5 AS base FROM s, crc_table),
v AS (SELECT h.*, LEAST(h.h, COALESCE(s.n, 0)) AS taken FROM h LEFT JOIN s ON s.c = h.base),
r AS (SELECT v.c, taken + pos - h AS idx, g, bytes FROM p JOIN v ON p.c = v.c WHERE pos >= h UNION ALL SELECT v.c, pos, g, bytes FROM v JOIN p ON p.c = v.base WHERE pos < taken),
k AS (SELECT c, idx + 1 AS d, bytes, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY idx)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM s),
e AS (SELECT *, MAX(d) OVER (PARTITION BY c) = d AS last, LAG(k) OVER (PARTITION BY c ORDER BY d) AS up FROM k),
n AS (SELECT d, k, MIN(c) AS c, MIN(up) AS up, COUNT(*) AS n_convs, MIN(bytes) AS bytes, COALESCE(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM e GROUP BY d, k),
b AS (SELECT n.*, q.c AS pc, (SELECT COUNT(*) FROM n x WHERE x.d = n.d + 1 AND x.up = n.k) AS kids FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.up),
t AS (SELECT e.d, e.k, SUM((b.n_convs - 1) * b.bytes) AS saved, COUNT(*) FILTER (WHERE b.kids = 0) AS leaves FROM b JOIN e ON e.c = b.c AND e.d <= b.d GROUP BY e.d, e.k)
SELECT b.c AS conv_id, CAST(b.d AS BIGINT) AS depth, b.pc AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM b JOIN t ON b.d = t.d AND b.k = t.k"""
