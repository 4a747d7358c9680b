"""Scans of real trees, manifests written and read back, and rules against plain loops."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from turnlake.functions import scalars
from turnlake.operators import aggregates, folds, intervals, joins, metrics, sampling, sweep
from turnlake.sources import readers, scans, sinks
from turnlake.streaming import windows

S = 1_000_000


def wav(seconds, rate=8000):
    data = bytes(2 * int(seconds * rate))
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Three recordings: JSON text before STM, STM alone, and one without any text; metadata for the first."""
    root = tmp_path_factory.mktemp("split")
    for k, seconds in ((1, 40), (2, 12), (3, 5), (4, 5)):
        (root / f"data{k}" / "labeled").mkdir(parents=True)
        if k < 4:
            (root / f"data{k}" / "mixture.wav").write_bytes(wav(seconds))
    one, two = root / "data1" / "labeled", root / "data2" / "labeled"
    lines = [(0.0, 4.0, "A", "xin chào"), (4.2, 8.0, "A", "các bạn"), (9.0, 9.5, "B", "vâng"), (9.6, 14.0, "B", "tôi là B"), (20.0, 39.9, "A", " ".join(f"w{i}" for i in range(30)))]
    (one / "transcript.jsonl").write_text("\n".join(json.dumps({"start": a, "end": b, "speaker": s, "text": t, "utt_id": f"u{a}"}) for a, b, s, t in lines) + "\nno json\n")
    (one / "mixture.stm").write_text("data1 1 A 0 4 <o,f0,unk> not this\n")
    (one / "mixture.rttm").write_text("".join(f"SPEAKER data1 1 {a} {b - a:.3f} <NA> <NA> {s} <NA> <NA>\n" for a, b, s, _ in lines) + "SPEAKER data1 1 3.0 2.0 <NA> <NA> B <NA> <NA>\n")
    (two / "mixture.stm").write_text("other 1 C 1 6 <o,f0,unk> hello there\nother 1 C 6.1 11.9 <o,f0,unk> again\n")
    (two / "mixture.rttm").write_text("SPEAKER other 1 1 10.9 <NA> <NA> C <NA> <NA>\n")
    (root / "data4" / "labeled" / "mixture.stm").write_text("data4 1 C 1 2 <o,f0,unk> no audio here\n")
    (root / "metadata.txt").write_text("data1 | Dustin On Go | A,B | 7\n# note\n")
    return str(root)


def test_split_of_a_tree(spark, tree):
    split = scans.read_split(spark, tree)
    assert {(r.file_id, r.duration_us) for r in split.recordings.collect()} == {("data1", 40 * S), ("data2", 12 * S), ("data3", 5 * S)}
    assert sorted((r.file_id, r.text) for r in split.text.where("start_us < 2000000").collect()) == [("data1", "xin chào"), ("data2", "hello there"), ("data4", "no audio here")]
    assert {r.file_id for r in split.turns.collect()} == {"data1", "data2"}
    assert {(r.file_id, r.unit) for r in split.units.collect()} == {("data1", f"u{a}") for a in (0.0, 4.2, 9.0, 9.6, 20.0)}
    of, made = scans.scan(split, "train", "self_labeled")
    rows = {r.file_id: r for r in of.collect()}
    assert set(rows) == {"data1", "data2"} and (rows["data1"].class_name, rows["data1"].bucket, rows["data1"].episode) == ("dustin_on_go", "silver_real", "7")
    assert (rows["data2"].class_name, rows["data2"].bucket) == ("data2", "silver_real")
    got = sorted((r.file_id, r.start_us, r.end_us, r.speaker, r.text, round(r.overlap_ratio, 4)) for r in made.collect())
    assert [g[:5] for g in got] == [
        ("data1", 0, 8_200_000, "A", "xin chào các bạn"),
        ("data1", 8_900_000, 14_200_000, "B", "vâng tôi là B"),
        ("data1", 19_900_000, 40 * S, "A", " ".join(f"w{i}" for i in range(30))),
        ("data2", 900_000, 12 * S, "C", "hello there again"),
    ]
    # B's extra turn meets A from 3 to 4 and from 4.2 to 5.
    assert [g[5] for g in got] == [round(1.8 / 8.2, 4), 0.0, 0.0, 0.0]


def test_reuse_is_limited_by_units(spark):
    rows = spark.createDataFrame([(f"s{k}", f"p{k // 3}", "vivos", k * S, f"data{k // 3}") for k in range(12)], "sample_id string, parent_id string, source_type string, start_us long, file_id string")
    units = spark.createDataFrame([("data0", "a"), ("data1", "a"), ("data1", "b"), ("data2", "b")], "file_id string, unit string")
    kept = sorted(r.sample_id for r in scans.limit_units(rows, units).collect())
    assert kept == sorted(["s0", "s1", "s6", "s7", "s9", "s10", "s11"])


def test_manifests_are_written_and_read(spark, tmp_path):
    parents = spark.createDataFrame([(f"p{k}", ["self_train", "dubbed_train", "vivos_train", "self_val"][k % 4], 3600 * S) for k in range(40)], "parent_id string, source_partition string, duration_us long")
    samples = spark.createDataFrame([(f"s{k}", f"p{k % 40}", ["self_train", "dubbed_train", "vivos_train", "self_val"][k % 4], (k % 10) / 20, k % 7) for k in range(400)], "sample_id string, parent_id string, source_partition string, overlap_ratio double, unit int")
    one = scans.stage_manifest(parents, samples, 0.18, 0.1, 42, unit="unit")
    rows = one.collect()
    train = [r for r in rows if r.part == "train"]
    # 20 base hours, so two hours of the ratio's source; the recording that crosses the target counts.
    assert len({r.parent_id for r in train if r.source_partition == "vivos_train"}) <= 2 and {r.source_partition for r in train} <= {"self_train", "dubbed_train", "vivos_train"}
    assert all(r.overlap_ratio <= 0.18 for r in train) and all(r.overlap_ratio <= 0.35 for r in rows)
    reused = [r.unit for r in train if r.source_partition == "vivos_train"]
    assert all(reused.count(u) <= 2 for u in reused) and {r.part for r in rows} == {"train", "val"}
    scans.export_manifests(f"{tmp_path}/out", parents, samples, {"stage1": one})
    assert scans.read_jsonl(spark, f"{tmp_path}/out/unified_manifest").count() == 400
    summary = {r.source_partition: (r.parents, r.samples, r.hours) for r in spark.read.json(f"{tmp_path}/out/scan_summary").collect()}
    assert summary["self_train"] == (10, 100, 10.0)
    back = spark.read.json(f"{tmp_path}/out/stages")
    assert back.where("split = 'train' and stage = 'stage1'").count() == len(train)


def test_runs_and_speakers(spark, tmp_path):
    for rel in ("a/der/x.rttm", "a/asr/asr_results.csv", "b/asr/asr_results.csv", "b/qwen/qwen_summary.md"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    got = {r.run: (r.has_der, r.has_asr, r.has_summary, r.file_count, r.status) for r in scans.read_runs(spark, str(tmp_path)).collect()}
    assert got == {"a": (True, True, False, 2, "complete"), "b": (False, True, True, 2, "partial")}
    (tmp_path / "V1").mkdir()
    (tmp_path / "V1" / "u.wav").write_bytes(wav(2.5))
    (tmp_path / "V1" / "bad.wav").write_bytes(b"junk")
    audio = scans.wav_micros(spark.createDataFrame([(f"file://{tmp_path}/V1/u.wav",), (f"file://{tmp_path}/V1/bad.wav",)], "path string"))
    assert [(r.speaker, r.duration_us) for r in scans.speaker_segments(audio, ["V1"]).collect()] == [("V1", 2_500_000)]


def test_bundle_and_report(spark, tmp_path):
    words = spark.createDataFrame([("r", 0, "A", 0, S, True, "hi"), ("r", 1, "B", S, 2 * S, False, "you")], "file_id string, pos int, speaker string, word_start_us long, word_end_us long, overlapped boolean, word string")
    lines = words.select("file_id", "speaker", F.col("word_start_us").alias("start_us"), F.col("word_end_us").alias("end_us"), F.col("word").alias("text"))
    sinks.write_bundle(f"{tmp_path}/b", lines, lines, words, spark.createDataFrame([("r", 2)], "file_id string, n int"))
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/b/words").collect()) == ["0.000 1.000 A [OVERLAP] hi", "1.000 2.000 B you"]
    assert readers.rttm(readers.read_lines(spark, f"{tmp_path}/b/rttm").select("value")).count() == 2
    sinks.write_report(spark.createDataFrame([(1, "x")], "n int, t string"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().t == "x"
    assert sinks.markdown_table(spark.range(1500)).count("\n") == 1501


def test_missing_case_fails_by_name(spark):
    samples = spark.createDataFrame([("data1", 1)], "case_id string, x int")
    chosen = spark.createDataFrame([("data1", 5.0), ("data9", 6.0)], "case_id string, noise double")
    assert joins.case_noise(chosen.where("case_id = 'data1'"), samples).first().noise == 5.0
    with pytest.raises(Exception, match="data9"):
        joins.case_noise(chosen, samples).collect()


def test_attempts(spark):
    calls = sweep.attempt(spark.createDataFrame([(1,), (2,)], "k int"), lambda row: str(10 // (row["k"] - 1)))
    assert sorted((r.k, r.result, r.error, r.tries) for r in calls.collect()) == [(1, None, "ZeroDivisionError: integer division or modulo by zero", 2), (2, "10", None, 1)]


@pytest.mark.parametrize("score,label", [(0.75, "good"), (0.7499, "usable"), (0.55, "usable"), (0.5, "needs_review"), (None, "needs_review")])
def test_labels(spark, score, label):
    assert spark.createDataFrame([(score,)], "s double").select(scalars.quality_label(F.col("s"))).first()[0] == label


def test_word_times_by_hand():
    """Two words over each other, then one far off; and one alone, too short and too long."""
    one = folds.clean_word_times([folds.Seg(1.0, 1.01, "", "a")])
    assert (one[0].start, one[0].end) == (0.9775, 1.0325)
    long = folds.clean_word_times([folds.Seg(0.0, 5.0, "", "a")])
    assert (long[0].start, long[0].end) == (1.525, 3.475)
    both = folds.clean_word_times([folds.Seg(0.0, 1.0, "", "a"), folds.Seg(0.5, 1.5, "", "b")])
    assert (both[0].start, both[0].end, both[1].start, both[1].end) == (0.0, 0.75, 0.75, 1.5)
    turned = folds.clean_word_times([folds.Seg(1.0, 0.5, "", "a")])
    assert (turned[0].start, turned[0].end) == (0.5, 1.0)
    # A gap of 0.89 is 0.4 too wide: each side takes half of that.
    wide = folds.clean_word_times([folds.Seg(0.0, 0.5, "", "a"), folds.Seg(1.39, 2.0, "", "b")])
    assert [round(x, 4) for s in wide for x in (s.start, s.end)] == [0.0, 0.7, 1.19, 2.0]


def test_turns_equal_a_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        turns = [(a := rng.randrange(100), a + rng.randrange(30), rng.choice("ABC")) for _ in range(rng.randrange(12))]
        found = folds.Turns(turns)
        for _ in range(20):
            a = rng.randrange(100)
            b, who = a + rng.randrange(1, 20), rng.choice("ABC")
            assert found.other_in(a, b, who) == any(s < b and a < e and w != who for s, e, w in turns)


def test_distances_equal_their_tables():
    rng = random.Random(5)

    def table(a, b):
        cost = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(cost[-1][j] + 1, row[-1] + 1, cost[-1][j - 1] + (x != y)))
            cost.append(row)
        return cost

    def split(a, b):
        cost, out, i, j = table(a, b), [0, 0, 0], len(a), len(b)
        while i or j:
            if i and j and a[i - 1] == b[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
                i, j = i - 1, j - 1
                continue
            k = 0 if i and j and cost[i][j] == cost[i - 1][j - 1] + 1 else 1 if i and cost[i][j] == cost[i - 1][j] + 1 else 2
            out[k], i, j = out[k] + 1, i - (k < 2), j - (k != 1)
        return tuple(out)

    for _ in range(800):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        assert metrics.levenshtein(a, b) == table(a, b)[-1][-1] and metrics.back_trace(a, b) == split(a, b)
    long = [str(rng.randrange(9)) for _ in range(400)]
    assert metrics.levenshtein(long, long[50:]) == 50 and metrics.common_subsequence(long, long[::2]) == 200


def test_assignment_is_the_best():
    from itertools import permutations

    rng = random.Random(6)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        w = [[rng.randrange(9) for _ in range(m)] for _ in range(n)]
        got = metrics.assignment(w)
        best = max(sum(w[i][c] for i, c in enumerate(p) if c < m) for p in permutations(range(max(n, m)), n))
        assert sum(w[i][c] for i, c in enumerate(got) if c >= 0) == best
    assert len(metrics.assignment([[1] * 60 for _ in range(60)])) == 60


def test_running_sums_equal_a_window(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = {r.k: r.before for r in sampling.running_before(df, ["g"], "k", F.col("v"), 42, "before").collect()}
    import hashlib

    for g in ("a", "b", None):
        total = 0
        for k, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: hashlib.md5(f"{r[0]}|42".encode()).hexdigest()):
            assert got[k] == total
            total += v


def test_draws_repeat_on_any_partitions(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "cast(id % 3 as string) as source")
    draw = lambda d: sorted(r.doc_id for r in sampling.with_replacement(d, "source", F.lit(1.0), 3000).collect())
    one = draw(df)
    assert one == draw(df.repartition(7)) and abs(len(one) - 3000) < 5 * 3000**0.5
    counts = [one.count(k) for k in range(2000)]
    assert sum(c == 0 for c in counts) / 2000 == pytest.approx(math.exp(-1.5), abs=0.04)


def test_evidence_by_hand(spark):
    items = [("f", 1, "A", [[5, 8]]), ("f", 2, "A", [[8, 5]]), ("f", 3, "A", [[8, 6], [5, 6]]), ("f", 4, "X", [[0, 99]]), ("f", 5, "A", []), ("f", 6, "A", [[1]]), ("f", 7, "A", [[10, 12]])]
    df = spark.createDataFrame(items, "file_id string, item_id long, speaker string, spans array<array<long>>")
    lines = spark.createDataFrame([("f", "A", 0, 10), ("f", "B", 0, 50)], "file_id string, speaker string, start_us long, end_us long")
    r = aggregates.evidence_rates(df, lines).first()
    # Met: 1, 2 (a line covers the reversed span), 3 (by its reversed first span, so the valid one is not tried), 7.
    assert (r.n_items, round(r.support_rate * 7), round(r.valid_rate * 7), round(r.presence_rate * 7)) == (7, 4, 3, 6)


def test_projection_by_alignment(spark):
    slots = spark.createDataFrame([("r", "s1", 0, 10 * S, ["x"]), ("r", "s2", 0, 10 * S, ["p", "q"])], "file_id string, source string, start_us long, end_us long, words array<string>")
    words = "array<struct<word:string,start:double,end:double>>"
    aligned = spark.createDataFrame([("s1", [("a", 0.0, 1.0), ("b", 1.5, 2.0)])], f"source string, words {words}")
    got = sorted((r.source, r.pos, r.word, r.word_start_us, r.word_end_us) for r in intervals.project_aligned(slots, aligned, "source").collect())
    assert got == [("s1", 0, "a", 0, 5 * S), ("s1", 1, "b", 7_500_000, 10 * S), ("s2", 0, "p", 0, 5 * S), ("s2", 1, "q", 5 * S, 10 * S)]


def test_known_ids_meet_words(spark):
    known = spark.createDataFrame([("data1",), ("data12",), ("a-b",)], "case_id string")
    lines = spark.createDataFrame([("x=1 path:/p/data12/q",), ("n=data1x z=2",), ("k=1 see a-b-c",), ("id=data7 data1",)], "value string")
    got = {r.value: r.case_id for r in readers.case_of(readers.record_maps(lines), known, ["id"]).collect()}
    assert got == {"x=1 path:/p/data12/q": "data12", "n=data1x z=2": None, "k=1 see a-b-c": "a-b", "id=data7 data1": "data7"}


def test_progress_lines(spark):
    rows = spark.createDataFrame([("PROGRESS:3/10",), ("x",), ("a PROGRESS:10/10 b",), (None,)], "value string")
    assert sorted((r.done, r.total) for r in windows.progress_lines(rows).collect()) == [(3, 10), (10, 10)]
