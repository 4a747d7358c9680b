"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 scatters whole records into buckets by a seeded hash of id and text; the number of buckets follows
from the bytes there are and from the memory that a task has, so that a bucket fits into it. Pass 2 sorts
each bucket by id, permutes it with Spark's shuffle() (a seeded Fisher-Yates), and writes it. The place of a
record in the whole permutation is its bucket's base, a prefix sum of bucket counts, plus its place in the
bucket; shards are equal cuts of that order, so their counts differ by one at most (law "rows").

Copies of one record (same id and text) share a hash. Where they are more bytes than a bucket should hold, they
are dealt out by a running number instead; such groups, fewer than buckets, are found by a partial count.
Records travel once, between the passes, and are written once, as Parquet with a bucket column; the digest
is read from what was written. Counts stay in Spark; the driver has the totals.

The permutation depends on the number of buckets, so on bucket_bytes; a given one makes it the same on
any cluster.

Edge cases: a null text has size 1 and the checksum of nothing; null, equal and repeated ids and equal
texts are separate records; ties of id and text are equal records, whose order cannot be told; an empty
table makes nothing; more shards than records leave shards empty; a text larger than a bucket has one that
is as large. Other columns of the input do not travel unless named in payload, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import compact, durable, hot_join, remove, shared_dir

SHARDS = 16
SEED = 91
#: Part of a task's memory that a bucket's texts take, and the least and most bytes of one.
BUCKET_PART, BUCKET_LEAST, BUCKET_MOST = 16, 8 << 20, 512 << 20
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket: a part of the memory that a task has."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-")
    said = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower().removesuffix("b")
    heap = int(said[:-1]) * _UNITS[said[-1]] if said[-1] in _UNITS else int(said) << 20
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "2"))
    return min(BUCKET_MOST, max(BUCKET_LEAST, heap // cores // BUCKET_PART))


def _large(records: DataFrame, bucket_bytes: int) -> DataFrame:
    """(key, n, parts) of the groups of equal records that are larger than a bucket should be, whatever their share
    of the rows. There are fewer of them than buckets."""
    groups = records.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return groups.where(F.col("bytes") > bucket_bytes).select("key", "n", F.ceil(F.col("bytes") / bucket_bytes).cast("long").alias("parts"))


#: Large groups that are broadcast, some 50 bytes each; with more, only those of a great share of the rows are.
BROADCAST_GROUPS = 1 << 16
#: Buckets whose bases are broadcast.
BROADCAST_BUCKETS = 1 << 20


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = (), shards: int = SHARDS, seed: int = SEED, bucket_bytes: int | None = None) -> DataFrame:
    """Shuffle into a new folder and return the placed records: id, text, payload, size, bucket,
    place, shard, slot."""
    spark = docs.sparkSession
    bucket_bytes = bucket_bytes or bucket_size(spark)
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key")
    record = docs.select(key, size, F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size, *(F.col(c).alias(f"p_{c}") for c in payload)).alias("r"))
    narrow = record.select("key", "size")
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_bytes))
    choice = F.xxhash64(F.lit(seed), F.col("key.id"), F.col("key.hash"))
    if buckets > 1:
        large = durable(_large(narrow, bucket_bytes), buckets)
        if large.count() <= BROADCAST_GROUPS:
            record = record.join(F.broadcast(large.drop("n")), "key", "left")
        else:
            record = hot_join(record, large, "key", "n", n)
        number = F.monotonically_increasing_id()
        choice = F.when(F.col("parts").isNull(), choice).otherwise(F.xxhash64(F.lit(seed), F.col("key.id"), F.col("key.hash"), number))
    scattered = record.select(F.pmod(choice, F.lit(buckets)).alias("bucket"), "r")
    gathered = scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "r.id", F.xxhash64("r.text")).groupBy("bucket").agg(F.collect_list("r").alias("rs"))
    permuted = gathered.select("bucket", F.posexplode(F.shuffle("rs", seed)).alias("place", "r")).select("bucket", F.col("place").cast("long").alias("place"), "r.*")
    permuted.write.parquet(path)
    written = spark.read.schema(permuted.schema).parquet(path)
    # One row a bucket: their prefix sums are one small task.
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = durable(counts.select("bucket", F.coalesce(before, F.lit(0)).alias("base")), buckets)
    # Sixteen bytes a bucket; beyond BROADCAST_BUCKETS texts travel once more.
    at = written.join(F.broadcast(bases) if buckets <= BROADCAST_BUCKETS else bases, "bucket").withColumn("at", F.col("base") + F.col("place"))
    placed = at.withColumn("shard", F.expr(f"((at + 1) * {shards} - 1) div {max(1, n)}"))
    return placed.withColumn("slot", F.expr(f"at - shard * {n} div {shards}")).drop("at", "base").withColumn("shard", F.col("shard").cast("int"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, size, text_crc32, law, shard, slot, grown_shard, read from the written shards,
    which then go."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    placed = write(docs, folder, id_col, text_col)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    read = durable(compact(placed.select(F.col("id").alias(id_col), "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), placed))
    remove(spark, folder)
    return read
