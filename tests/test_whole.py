"""Queries over inputs that an upper bound on words, rows or repeats would cut, against plain versions."""

import pytest

from test_operators import lev
from turnlake.registry import QUERIES

WORDS = [f"w{k % 17}" for k in range(100)]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("turns"))
    rows = [(1, 0, "user", " ".join(WORDS)), (1, 1, "assistant", " ".join(reversed(WORDS))), (2, 0, "user", "a b c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_reference_lines_keep_all_words(spark, turns):
    from turnlake.plans.views import hyp_lines, ref

    lines = {(r.file_id, r.seg_id): r for r in ref(spark, turns).collect()}
    assert lines[1, 0].words == WORDS and lines[1, 1].words == WORDS[::-1]
    assert (lines[1, 1].start_us, lines[1, 1].end_us) == (100 * 400_000, 200 * 400_000)
    assert [len(r.words) for r in hyp_lines(spark, turns).where("hyp_id = 1000").collect()] == [86]
    assert [r.text for r in QUERIES["src_stm_labelled"](spark, turns).where("file_id = '1' and start_us = 0").collect()] == [" ".join(WORDS)]


def test_edit_distance_of_whole_turns(spark, turns):
    found = {r.hyp_id: (r.edits, r.n_words) for r in QUERIES["met_edit_distance"](spark, turns).collect()}
    kept = [w for k, w in enumerate(WORDS, 1) if k % 7]
    assert found[1000] == (lev(WORDS, kept), 100)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def rouge(a, b):
    n = lcs(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def test_rouge_of_whole_roles(spark, tmp_path):
    a, b = [f"w{k % 23}" for k in range(90)], [f"w{k % 19}" for k in range(70)]
    rows = [
        (1, 0, "user", " ".join(a)),
        (1, 1, "assistant", "Yes it  is"),
        (1, 2, "user", " ".join(b)),
        (1, 3, "assistant", "it is not"),
        (1, 4, "user", " ".join(a)),
        (1, 5, "tool", "x"),
        (2, 0, "user", "a"),
        (2, 1, "user", "b c"),
        (2, 2, "user", "a b"),
        (2, 4, "user", "c"),
        (3, 0, "user", None),
        (3, 2, "user", "a"),
        (4, 0, "user", "a"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.common, r.rouge_l) for r in QUERIES["met_speaker_rouge"](spark, str(tmp_path)).collect()}
    first = (rouge(a, b + a) + rouge("yes it is".split(), "it is not".split())) / 2
    assert got[1] == (2, pytest.approx(first)) and got[2] == (1, 1.0) and got[3] == (1, 0.0) and 4 not in got


def test_pivot_has_all_thresholds(spark, data):
    got = QUERIES["agg_threshold_pivot"](spark, data).collect()
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_returnflag", "l_linenumber", "l_quantity").collect()
    whole = {}
    for r in lines:
        whole[r[0], str(r[1])] = whole.get((r[0], str(r[1])), 0) + int(r[2])
    assert {k for _, k in whole} == set("1234567")
    assert {(r.grp, k): r[k] for r in got for k in r.asDict() if k != "grp" and r[k] is not None} == whole


def test_small_sources_get_their_share(spark):
    from pyspark.sql import functions as F

    from turnlake.operators import sampling

    rows = [(k, "large") for k in range(3000)] + [(3000, "one"), (3001, "two"), (3002, "two")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    drawn = {r.source: r.n for r in sampling.with_replacement(df, "source", F.lit(1.0), 6000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(drawn[s] - 2000) < 5 * 2000**0.5 for s in ("large", "one", "two"))
    assert sampling.with_replacement(df, "source", F.lit(1.0), 6000).columns == ["doc_id", "source"]
