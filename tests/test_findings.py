"""Cases that reviews found."""

import json
import os
import random

import public_tokenizers

from turnlake.llm import bpe, token_files
from turnlake.operators import joins as J
from turnlake.registry import QUERIES
from turnlake.sources import scans, sinks
from turnlake.streaming import progress


def test_progress_beyond_the_total(spark, tmp_path):
    """More done than the total tells: the time left is below zero and cut toward zero, as in SQL."""
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/0.json", "w") as f:
        f.write("\n".join(json.dumps({"session": "a", "stage": "der", "ts": f"2024-01-01T00:00:{s:02d}Z", "value": v}) for s, v in ((0, "start"), (10, "PROGRESS:7/5"))))
    lines = spark.readStream.schema("session string, stage string, ts timestamp, value string").json(f"{tmp_path}/in")
    (row,) = progress.run_progress(lines, f"file://{tmp_path}/out").collect()
    assert (row.done, row.total, row.elapsed_us, row.left_us) == (7, 5, 10_000_000, -2_857_142)


def _segments(seed: int, n: int, speakers: int, first_id: int = 0) -> list[tuple]:
    """Segments that start and end on few places, so that times are equal; some have no length, some are long."""
    r = random.Random(seed)
    return [("ab"[r.random() < 0.3], first_id + k, f"s{r.randrange(speakers)}" if r.random() < 0.95 else None, a, a + r.choice((0, 1, 3, 7, 20, 90))) for k in range(n) for a in [r.randrange(150)]]


SCHEMA = "file_id string, seg_id long, speaker string, start_us long, end_us long"


def test_first_partner_makes_no_pairs(spark):
    """Partners and their numbers as plain loops find them, over slices shorter than segments, without a join."""
    for seed, speakers, least in ((1, 2, 0), (2, 5, 2), (3, 40, 0)):
        rows = _segments(seed, 160, speakers)
        found = J.first_partner(spark.createDataFrame(rows, SCHEMA), ["file_id"], least, slice_us=25)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {}
        for f, i, who, a, b in rows:
            near = sorted((x, j) for g, j, other, x, y in rows if g == f and who and other and other != who and min(b, y) - max(a, x) > least)
            if near:
                want[i] = (near[0][1], len(near))
        assert {r.seg_id: (r.partner, r.n_partners) for r in found.collect()} == want


def test_best_overlap_speaker_of_covered_items(spark):
    """Items inside turns, across them, around them and without length, against plain loops; those inside a turn
    are found by a sweep, so they make no pair."""
    for seed in (4, 5):
        items, turns = _segments(seed, 120, 3, 1000), _segments(seed + 10, 120, 6)
        frames = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(turns, SCHEMA)
        want = {}
        for f, i, _, a, b in items:
            near = [(max(a, x) - min(b, y), x, j, who) for g, j, who, x, y in turns if g == f and a < y and x < b]
            want[i] = (min(near)[3] if near else None) or "Unknown"
        found = J.best_overlap_speaker(*frames, ["file_id"], "seg_id", slice_us=25)
        assert {r.seg_id: r.assigned for r in found.collect()} == want
        inside = {i for f, i, _, a, b in items if any(g == f and (x <= a and b <= y if a < b else x < a < y) for g, _, _, x, y in turns)}
        assert {r.seg_id for r in J._covering(*frames, ["file_id"], "seg_id", 25).collect()} == inside


def test_bpe_rounds_equal_the_index():
    """Words replay in rounds to the ids that the index of pairs gives, repeats (a a a) and odd bytes too."""
    c = bpe.Coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(6)
    words = [b"a" * 13, b" ", b"\xff\xfe", *(bytes(r.choice(b"aaabnt he\xc3\xa9\xf0") for _ in range(r.randrange(1, 65))) for _ in range(2000))]
    assert c.rounds(words) == c.replay(words)
    assert c.rounds([]) == []
    text = " ".join(w.decode("latin-1") for w in words)
    assert c.decode(c.encode(text)).decode() == text


def test_token_pieces_without_the_pattern():
    """Words of Latin letters before marks and odd white space get the tokenizers library's ids."""
    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["It's a word, é.  Two  spaces, ß! end ", "naïve? x÷y ×. ªº µm ɏɐ. don't 'tis word.\nNext ,;  a, ", " lead, a b. ", ".", "a. a.. a: a1, İi."]
    for t in [*texts, *texts]:
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == b"".join(k.to_bytes(e.kind.itemsize, "little") for k in want), t


def test_manifests_are_gzipped(spark, tmp_path):
    """Manifests are stored compressed; readers take them as they are."""
    rows = spark.range(50).selectExpr("cast(id as string) as sample_id", "'stage1' as stage", "'train' as split")
    sinks.write_manifests(rows, f"file://{tmp_path}/stages", compression="gzip")
    files = [f for _, _, fs in os.walk(tmp_path) for f in fs if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert scans.read_jsonl(spark, f"file://{tmp_path}/stages").count() == 50


def test_pairs_meet_in_one_pass(spark, data, monkeypatch):
    """Pairs as plain loops find them, over slices shorter than segments and in small blocks and batches; ids that come
    twice, ends before starts and nulls are among the segments. They travel once, without a join."""
    for seed, speakers, cells, batch in ((1, 2, 1, 7), (2, 5, 300, 1000), (3, 40, 1 << 18, 50)):
        monkeypatch.setattr(J, "PAIR_CELLS", cells)
        rows = _segments(seed, 160, speakers) + _segments(seed + 10, 20, speakers, 150) + [("a", 500, "s0", 40, 30), ("a", 501, "s1", 40, 70), (None, 502, "s0", 0, 90), ("a", None, "s0", 0, 90), ("b", 503, "s0", None, 90)]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = sorted(map(tuple, J.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), ["file_id"], slice_us=25).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        whole = [r for r in rows if None not in r]
        assert found == sorted((i, a, b, j, x, y) for f, i, who, a, b in whole for g, j, other, x, y in whole if f == g and i < j and who != other and a < y and x < b)
    plan = QUERIES["iv_pairs_overlap_iou"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_pairs_of_segments_without_a_partner(spark):
    """No rows, one row, and slices of which none has a pair."""
    for rows in ([], [("a", 1, "x", 0, 10)], [("a", k, "xy"[k % 2], 30 * k, 30 * k + 30) for k in range(40)]):
        assert J.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), ["file_id"], slice_us=100).collect() == []


def test_pairs_of_a_segment_stand_together(spark):
    """Pairs of a segment are two runs at most, one for each side of the ids; partners that end after it come first in a run."""
    ids = random.Random(4).sample(range(400), 400)
    rows = [("a", i, "xyz"[k % 3], 10 * k, 10 * k + 10 * (7 * k % 90) + 5) for k, i in enumerate(ids)]
    pairs = [tuple(r) for r in J.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), ["file_id"], slice_us=10_000).collect()]
    later = [(max((p[1], p[0]), (p[4], p[3]))[1], p[1] > p[4]) for p in pairs]
    runs = [k for k in range(len(later)) if not k or later[k] != later[k - 1]]
    assert len(pairs) > 5000 and len(runs) == len(set(later))
    for a, b in zip(runs, [*runs[1:], len(pairs)]):
        ends = [p[5] if p[1] > p[4] else p[2] for p in pairs[a:b]]
        assert ends == sorted(ends, reverse=True)
