"""Random keys of several encodings and prefixes, and runs of ordinary text, for the secret battery."""

import random
import uuid

from turnlake.llm import secret_scan

HEX, LOWER, LETTERS = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WORDS = "annotation recording speaker channel overlap segment window transcript duration merge threshold between pipeline reference".split()
SCHEMA = "doc_id long, text string"


def found(spark, runs):
    """Share of the runs that have exactly their own span, one in each text."""
    df = spark.createDataFrame([(k, f"see {r} end") for k, r in enumerate(runs)], SCHEMA)
    spans = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    return sum(spans[k] == f"random:4:{4 + len(r)}" for k, r in enumerate(runs)) / len(runs)


def test_random_keys_have_spans(spark):
    rng = random.Random(5)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = {
        "uuid": (lambda: str(uuid.UUID(int=rng.getrandbits(128))), 0.95),
        "0x": (lambda: "0x" + pick(HEX, 40).upper(), 0.95),
        "sk-": (lambda: "sk-" + pick(HEX, 20), 0.9),
        "sk_live_": (lambda: "sk_live_" + pick(LETTERS + "0123456789", 24), 0.9),
        "base36 of 24": (lambda: pick(LOWER, 24), 0.85),
        "base36 of 32": (lambda: pick(LOWER, 32), 0.9),
        "no digit": (lambda: pick(LETTERS, 40), 0.9),
    }
    shares = {k: found(spark, [make() for _ in range(150)]) for k, (make, _) in kinds.items()}
    assert all(shares[k] >= least for k, (_, least) in kinds.items()), shares


def test_ordinary_runs_have_none(spark):
    rng = random.Random(6)
    runs = []
    for k in range(300):
        words = [rng.choice(WORDS) for _ in range(4)]
        runs.append(["_".join(words), "/".join(words) + "_v2", "".join(map(str.title, words)), "-".join(words).upper() + "-2024"][k % 4])
    runs += ["-" * 40, "=" * 30, "_" * 25 + "a"]
    df = spark.createDataFrame([(k, f"see {r} end") for k, r in enumerate(runs)], SCHEMA)
    assert sum(r.n_random for r in secret_scan.scan(df).collect()) <= 3


def test_masked_whole(spark):
    df = spark.createDataFrame([(1, "id 3f2b8c1e-9d47-4a60-b5e8-17c0d2f6a934 end")], SCHEMA)
    assert secret_scan.redact(df).first().text == "id [SECRET] end"
