"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text without white space is cut into blocks of BLOCK bytes. Level 0 sorts the different blocks into integer
names: by their 64-bit hash, and blocks that share a hash by their bytes, so equal names mean equal blocks.
Every further level takes neighbouring names of a document as pairs, an odd last one alone, and sorts the
different pairs into new integers, until a document has one name. Names of all levels are one sequence, so
texts are equal if and only if their last names are: no step trusts a hash.

Whole blocks travel once, to be told apart (copies meet in the partial aggregate before); documents travel as
hashes and names. Names of frequent blocks, pairs and groups meet a broadcast table of bounded size
(common.hot_join), so copies of a third of all rows are no one task's. Levels are as many as the binary
logarithm of the longest text's blocks, and a document takes part until it has its name; the driver holds
counts. Every level ends in a checkpoint.

Edge cases: a null text counts as empty; texts without anything but white space are equal; null ids are rows
like any other and come last among ids; repeated rows are a group of which one row is kept; of rows with as
many code points and the same id any one is kept, they cannot be told apart by what decides; a long text is cut
by bytes, so its cost is linear; an empty table gives an empty result. Other columns of the input are ignored,
whatever their names, and carried by keep_first().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, compact, durable, hot_join, written

BLOCK = 4096
#: Bits that monotonically_increasing_id() has for the row in its partition.
_ROW_BITS = 33


def normal(text: Column) -> Column:
    """The text without white space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def blocks(text: Column, block: int = BLOCK) -> Column:
    """array<binary>: the bytes of the normal text, block at a time; one empty block for an empty text."""
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.octet_length(b) - 1) / block).cast("int")), lambda i: F.substring(b, i * block + 1, F.lit(block)))
    # The array of one makes the normal text a variable, which is computed once.
    return F.get(F.transform(F.array(normal(text).cast("binary")), cut), F.lit(0))


def _hash(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits)


def sorted_names(keys: DataFrame, by: list[str], first: int) -> DataFrame:
    """Adds name: first plus the place of a row in the order of by (rows are different). Partitions are ranges
    of the order, so a place is the rows of the ranges before and those before it in its own."""
    ranged = durable(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    part, row = F.shiftright("__m", _ROW_BITS), F.col("__m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row a partition.
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("__part", before.alias("__base")))
    return ranged.withColumn("__part", part).join(bases, "__part").withColumn("name", F.lit(first) + F.col("__base") + row).drop("__part", "__m", "__base")


def _names(pieces: DataFrame) -> tuple[DataFrame, int, int]:
    """(h, contents, n, name) of the hashes of all blocks, how many blocks there are, and how many hashes stand
    for more than one content. pieces: (h, block)."""
    told = pieces.groupBy("h", "block").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("contents"), F.sum("n").alias("n"))
    named = durable(sorted_names(told, ["h"], 0))
    total, shared = named.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("contents") > 1, 1))).first()
    return named, total, shared


def _next_level(rows: DataFrame, first: int, most: int) -> tuple[DataFrame, int]:
    """(rid, pos, left, name) of the pairs of neighbouring names, and how many new names there are. most: a
    bound on the rows."""
    side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
    pairs = rows.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(F.max("left").alias("left"), F.struct(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")).alias("pair"))
    pairs = durable(pairs.withColumn("left", F.shiftright(F.col("left") + 1, 1)), most)
    names = durable(sorted_names(pairs.groupBy("pair").agg(F.count("*").alias("n")), ["pair"], first), most)
    made, total = names.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return hot_join(pairs, names, "pair", "n", total).select("rid", "pos", "left", "name"), made


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64, rid: str | None = None) -> DataFrame:
    """One row per input row: id, n_chars (code points of the original text), sha256 (of the normal one), rid
    (a number of its own: the named column's, else a new one) and name, the integer that equal texts share.
    bits: of the hash that sorts blocks."""
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    source = docs.select(number.alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def stored(source: DataFrame) -> DataFrame:
        size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
        sha = F.sha2(normal(F.col("text")).cast("binary"), 256)
        hashes = F.transform(blocks(F.col("text"), block), lambda b: _hash(b, bits))
        return written(compact(source.select("rid", "id", size.alias("n_chars"), sha.alias("sha256"), hashes.alias("hashes")).withColumn("left", F.size("hashes")), docs), "exact-rows")

    kept = stored(source)
    cut = source.select("rid", F.posexplode(blocks(F.col("text"), block)).alias("pos", "block"))
    named, total, shared = _names(cut.select(_hash(F.col("block"), bits).alias("h"), "block"))
    if shared:
        # Blocks of a hash with several contents are named by their bytes; texts are stored first, so that
        # these blocks and the rows have the same numbers.
        source = written(source, "exact-texts")
        kept = stored(source)
    rows = hot_join(kept.select("rid", "left", F.posexplode("hashes").alias("pos", "h")), named.where("contents = 1").select("h", "name", "n"), "h", "n", total)
    first = named.count()
    if shared:
        several = named.where("contents > 1").select("h")
        doubtful = source.select("rid", F.posexplode(blocks(F.col("text"), block)).alias("pos", "block")).withColumn("h", _hash(F.col("block"), bits)).join(several, "h", "left_semi")
        exact = durable(sorted_names(doubtful.groupBy("h", "block").agg(F.count("*").alias("n")), ["h", "block"], first), total)
        first += exact.count()
        key = F.struct("h", "block").alias("key")
        found = hot_join(doubtful.select("rid", "pos", key), exact.select(key, F.col("name").alias("by_bytes"), "n"), "key", "n", total).select("rid", "pos", "by_bytes")
        rows = rows.join(found, ["rid", "pos"], "left").withColumn("name", F.coalesce("name", "by_bytes"))
    rows = durable(rows.select("rid", "pos", "left", "name"), total)
    done = rows.where("left = 1").select("rid", "name")
    while not (rows := rows.where("left > 1")).isEmpty():
        rows, made = _next_level(rows, first, total)
        rows, first = durable(rows, total), first + made
        done = done.unionByName(rows.where("left = 1").select("rid", "name"))
    return kept.drop("hashes", "left").join(done, "rid")


def _groups(found: DataFrame) -> DataFrame:
    """identities() with group_size and first, the row that stays: less, none, id, rid."""
    found = durable(found)
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "rid")
    groups = found.groupBy("name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"), F.count("*").alias("n"))
    return hot_join(found, durable(groups), "name", "n", found.count())


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per input row: id_col, keep_id (of the row that stays of its group: most code points, then the
    least id, null last), group_size, kept, text_sha256."""
    found = _groups(identities(docs, id_col, text_col, block, bits))
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha256").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with one row of each group of equal texts, the one that stays."""
    # Rows are written with their numbers, so that the pass that reads them last sees the same ones.
    stored = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(c) for c in docs.columns)).alias("row")), "exact-input")
    plain = stored.select("rid", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"))
    stay = _groups(identities(plain, "id", "text", rid="rid")).where("rid = first.rid").select("rid")
    return compact(stored.join(stay, "rid", "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns)), docs)


#: The same rows from DuckDB.
ORACLE = """WITH n AS (SELECT doc_id, COALESCE(length(text), 0) AS size, regexp_replace(COALESCE(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, FIRST_VALUE(doc_id) OVER w AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size, ROW_NUMBER() OVER w = 1 AS kept, sha256(t) AS text_sha256 FROM n
WINDOW w AS (PARTITION BY t ORDER BY size DESC, doc_id NULLS LAST)"""
