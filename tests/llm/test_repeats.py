"""Repeated and null ids in the operators that the pipeline applies, and draws against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import common, mixing, simhash

SCHEMA = "doc_id long, text string, source string, lang string"
A = "the quick brown fox jumps over the lazy dog near the river bank today"
B = "completely other words stand here for another text about nothing at all"


def test_one_row_of_each_component_with_repeated_and_null_ids(spark):
    rows = [(3, B, "s", "x"), (5, A, "s", "x"), (5, B, "s", "x"), (None, A, "s", "x"), (None, "alone and without an id or a twin in the table", "s", "x"), (None, "alone and without an id or a twin in the table", "s", "x"), (9, None, "s", "x"), (9, None, "s", "x")]
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(3, B), (5, A), (None, rows[4][1]), (9, None)], key=repr)


def test_hot_join_equals_a_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.choice([0, 0, 0, rng.randrange(900)]), k) for k in range(3000)] + [(None, -1)], "k long, v long")
    table = rows.where("k is not null and k % 3 < 2").groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 2)
    got = common.hot_join(rows, table, "k", "n", 3000 * common.HOT_SHARE // 5)
    want = rows.join(table.drop("n"), "k", "left").select("k", "v", "w")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_applied_rows_are_the_draws(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) if k % 3 else None, "w " * rng.randrange(9), "abc"[k % 7 % 3], str(k)) for k in range(2000)] + [(7, "same text", "a", "x")] * 900
    df = spark.createDataFrame(rows, SCHEMA)
    plan, _ = mixing.plan(df)
    taken = Counter()
    for r in plan.collect():
        taken[r.id, r.size, r.source] += r.copies
    out = mixing.apply(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, len(r.text.split()), r.source) for r in out.collect())
    assert got == +taken
    for s, n in Counter(r[2] for r in rows).items():
        goal = {r.source: (r.target, r.source_size) for r in plan.select("source", "target", "source_size").distinct().collect()}[s]
        words = sum(k[1] * c for k, c in got.items() if k[2] == s)
        assert goal[0] - 9 <= words <= goal[0] + 1 and n


def test_applied_order_is_that_of_the_shards(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(id % 5 as int)) as text", "cast(id % 2 as string) as source")
    place = {(r.id, r["pass"]): (r.shard, r.position) for r in mixing.mix(df).collect()}
    seen = Counter()
    for part in mixing.apply(df).select("doc_id", F.spark_partition_id().alias("p")).collect():
        seen[part.doc_id] += 1
    assert seen == Counter(i for i, _ in place)
    rows = mixing._drawn(*mixing.plan(df, carry=True), mixing.SEED).select("id", "pass", "shard", "slice", "order").collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for s, mine in by.items():
        mine.sort(key=lambda r: (r.slice, r.order, r.id, r["pass"]))
        assert [place[r.id, r["pass"]] for r in mine] == [(s, k + 1) for k in range(len(mine))]


def test_slices_keep_positions(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as doc_id", "'a b' as text", "cast(id % 2 as string) as source")
    one = {(r.id, r["pass"]): (r.shard, r.position) for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "SLICE", 50)
    assert {(r.id, r["pass"]): (r.shard, r.position) for r in mixing.mix(df).collect()} == one


def test_tree_draws_without_replacement():
    """Each shard's number of one source's blocks: mean and variance of a hypergeometric draw, and the
    same as dealing shuffled blocks out, which is the plain way to the same distribution."""
    quotas, shards, n = np.array([30, 10]), 4, 3000
    tree = np.array([mixing.split_tree(quotas, shards, seed)[:, 1] for seed in range(n)])
    rng, plain = np.random.default_rng(1), []
    for _ in range(n):
        deck = rng.permutation(np.repeat([0, 1], quotas))
        plain.append([d.sum() for d in np.split(deck, shards)])
    plain = np.array(plain)
    variance = 10 * (10 / 40) * (30 / 40) * (30 / 39)
    for draws in (tree, plain):
        assert draws.sum(1).tolist() == [10] * n
        assert draws.mean(0) == pytest.approx([2.5] * shards, abs=0.1) and draws.var(0) == pytest.approx([variance] * shards, rel=0.1)
    for k in range(6):
        assert (tree[:, 2] == k).mean() == pytest.approx((plain[:, 2] == k).mean(), abs=0.04)
