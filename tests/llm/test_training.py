"""Toxicity training where the texts are, against the same steps in memory; state of Python workers."""

from pyspark.sql import functions as F

from turnlake.llm import common, toxicity


def test_distributed_training_equals_that_in_memory(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.train(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = [(text[r.doc_id], int(r.toxic)) for r in labels.where(~toxicity.held_out("doc_id") & F.col("toxic").isin(0, 1)).collect() if r.doc_id in text]
    want = toxicity.fit(rows)
    assert (got.terms, got.stems, got.clean) == (want.terms, want.stems, want.clean)
    assert abs(got.rate - want.rate) < 1e-12 and max(abs(a - b) for a, b in zip(got.weights, want.weights, strict=True)) < 1e-6


def test_repeated_ids_and_labels_count_once(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    one, two = toxicity.train(docs, labels), toxicity.train(docs.unionAll(docs), labels.unionAll(labels))
    assert one.terms == two.terms and max(abs(a - b) for a, b in zip(one.weights, two.weights, strict=True)) < 1e-9


def test_a_cut_class_does_not_shift_scores(spark, data, monkeypatch):
    """With fewer clean texts in the sample than labels have, scores stay near the share of toxic labels."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    monkeypatch.setattr(toxicity, "PER_CLASS", 12)
    model = toxicity.train(docs, labels)
    usable = labels.where(~toxicity.held_out("doc_id") & F.col("toxic").isin(0, 1))
    share = usable.agg(F.avg("toxic")).first()[0]
    found = toxicity.score(docs.join(usable.select("doc_id"), "doc_id"), model).agg(F.avg("score")).first()[0]
    assert abs(found - share) < 0.08


def test_one_label_trains_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) == toxicity.Model()


def test_a_worker_keeps_one_state():
    made = []
    make = lambda: made.append(1) or object()
    a = common.worker_state(("a",), make)
    assert common.worker_state(("a",), make) is a and len(made) == 1
    common.worker_state(("b",), make)
    assert common.worker_state(("a",), make) is not a and len(made) == 3


def test_cache_is_bounded_by_its_charge():
    c = common.Cache(1000, 500)
    for k in range(1000):
        c.room()
        c.add(k, k, 100)
    assert len(c.map) <= 17 and all(c.map[k] == k for k in range(10))
