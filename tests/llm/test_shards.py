"""Sharding against a plain permutation, hot records, and folders that go."""

import glob
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from turnlake.llm import common, sharding, token_files

SCHEMA = "doc_id long, text string"


def test_places_equal_prefix_sums(spark, tmp_path):
    """Shards and slots from bucket and place by a plain loop; buckets from the hash of id and text."""
    rng = random.Random(1)
    rows = [(rng.randrange(300), "x" * rng.randrange(200)) for _ in range(800)] + [(None, None), (None, "y")]
    got = sharding.write(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/out", shards=7, bucket_bytes=8000).collect()
    n_buckets = -(-sum(len(t or "") + 1 for _, t in rows) // 8000)

    def bucket(i, t):
        h = 42
        for x in (sharding.SEED.to_bytes(4, "little"), None if i is None else i.to_bytes(8, "little"), None):
            h = h if x is None else xxhash.xxh64_intdigest(x, h)
        text = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        h = xxhash.xxh64_intdigest(text.to_bytes(8, "little"), h)
        return (h - (1 << 64) if h >> 63 else h) % n_buckets

    assert Counter((r.id, r.text, r.bucket) for r in got) == Counter((i, t, bucket(i, t)) for i, t in rows)
    ordered = sorted(got, key=lambda r: (r.bucket, r.place))
    bounds = [k * len(rows) // 7 for k in range(8)]
    for at, r in enumerate(ordered):
        shard = max(k for k in range(7) if bounds[k] <= at)
        assert (r.shard, r.slot) == (shard, at - bounds[shard])


def test_equal_records_fill_many_buckets(spark, tmp_path):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, -7, id) as doc_id", "if(id % 3 = 0, 'same text of one hot record', concat('t', id)) as text")
    rows = sharding.write(df, f"{tmp_path}/out", bucket_bytes=4000).collect()
    assert len(rows) == 3000 and sum(r.id == -7 for r in rows) == 1000
    by = Counter(r.bucket for r in rows if r.id == -7)
    assert max(by.values()) < 400 and len({(r.shard, r.slot) for r in rows}) == 3000
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1


def test_permutation_is_uniform(spark, tmp_path):
    """A record's shard and place do not follow its id: correlation and shard counts near chance."""
    df = spark.range(8000).selectExpr("id as doc_id", "repeat('a', 50) as text")
    rows = sharding.write(df, f"{tmp_path}/out", bucket_bytes=50_000).withColumn("at", F.col("shard") * 500 + F.col("slot"))
    assert abs(rows.stat.corr("id", "at")) < 0.05
    low = Counter(r.shard for r in rows.where("id < 4000").collect())
    assert all(abs(low[s] - 250) < 6 * 125**0.5 for s in range(16))


def test_folders_go(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    assert sharding.digest(df).count() == token_files.round_trip(df).count() == 2
    folder = common.shared_dir(spark).removeprefix("file://")
    assert not glob.glob(f"{folder}/shards-*") and not glob.glob(f"{folder}/tokens-*")


def test_copies_of_a_small_share_are_dealt_out(spark, tmp_path, monkeypatch):
    """A group far below 1/4096 of all rows, but larger than a bucket; with too many such groups to broadcast too."""
    df = spark.range(30_000).selectExpr("if(id < 6, -7, id) as doc_id", "if(id < 6, repeat('long text ', 1000), 'short') as text")
    for k, most in enumerate((1 << 16, 0)):
        monkeypatch.setattr(sharding, "BROADCAST_GROUPS", most)
        rows = sharding.write(df, f"{tmp_path}/{k}", bucket_bytes=20_000).select("id", "bucket", "size", "shard", "slot").collect()
        held = Counter()
        for r in rows:
            held[r.bucket] += r.size
        assert len({r.bucket for r in rows if r.id == -7}) > 1 and len(rows) == len({(r.shard, r.slot) for r in rows}) == 30_000
        assert max(held.values()) < 3 * 20_000


def test_null_ids_are_many_shards(spark, tmp_path):
    import public_tokenizers

    df = spark.range(4000).selectExpr("if(id % 2 = 0, null, id % 5) as doc_id", "concat('text ', id) as text").repartition(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = token_files.write(df, f"{tmp_path}/t", path, shard_bytes=max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 20))
    sizes = [r.n_docs for r in shards.collect()]
    assert len(sizes) > 15 and max(sizes) < 1000
    got = token_files.read(shards).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is not None for r in ordered] == sorted(r.doc_id is not None for r in ordered)
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and sum(r.doc_id is None for r in got) == 2000
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
