"""Edge cases and properties of the interval, metric, fold and reader operators."""

import random

import pytest
from pyspark.sql import functions as F

from turnlake.functions import scalars, text
from turnlake.operators import folds, intervals, metrics
from turnlake.sources import readers, sinks

S = 1_000_000
KIND = "file_id string, seg_id long, speaker string, start_us long, end_us long"


def segs(spark, *rows):
    return spark.createDataFrame([("r", k, s, int(a * S), int(b * S)) for k, (s, a, b) in enumerate(rows)], KIND)


CASES = [
    ([("A", 0, 5), ("B", 3, 8), ("C", 10, 15)], [(0, 8), (10, 15)], [(3, 5)], 2, 1),
    ([("A", 0, 5), ("B", 5, 8)], [(0, 8)], [], 0, 1),
    ([("A", 0, 10), ("B", 2, 4)], [(0, 10)], [(2, 4)], 2, 1),
    ([("A", 0, 5), ("A", 3, 8)], [(0, 8)], [(3, 5)], 2, 1),
    ([("A", 0, 5), ("B", 5.1, 8)], [(0, 8)], [], 0, 0),
    ([], [], [], None, None),
]


@pytest.mark.parametrize("rows,union,regions,overlap,count", CASES)
def test_interval_matrix(spark, rows, union, regions, overlap, count):
    s = segs(spark, *rows)
    get = lambda df: sorted((r.start_us / S, r.end_us / S) for r in df.collect())
    assert get(intervals.islands(s, gap_us=150_000)) == union
    assert get(intervals.overlap_regions(s)) == regions
    profile, starts = intervals.time_profile(s).collect(), intervals.overlap_starts(s).collect()
    assert [r.overlap_us for r in profile] == ([] if overlap is None else [overlap * S])
    assert [r.overlap_count for r in starts] == ([] if count is None else [count])


def test_gaps(spark):
    s = segs(spark, *CASES[0][0])
    d = spark.createDataFrame([("r", 20 * S)], "file_id string, duration_us long")
    assert sorted((r.start_us // S, r.end_us // S) for r in intervals.gaps(s, d, 100_000).collect()) == [(8, 10), (15, 20)]


def test_split_keeps_the_measure(spark):
    s = segs(spark, ("A", 0, 100), ("B", 5, 6))
    assert intervals.split_long(s, 29 * S).agg(F.sum(F.expr("end_us - start_us"))).first()[0] == 101 * S


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_metrics(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(8))], [rng.choice("abcd") for _ in range(rng.randrange(8))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    out = df.select("a", "b", metrics.edit_distance("a", "b").alias("d"), metrics.rouge_l("a", "b").alias("r"), metrics.rouge_l("b", "a").alias("q"), metrics.word_errors("a", "b").alias("e")).collect()
    for x in out:
        assert x.d == lev(x.a, x.b) == sum(x.e)
        assert x.e.deletions - x.e.insertions == len(x.a) - len(x.b)
        assert 0 <= x.r <= 1 and abs(x.r - x.q) < 1e-12


def test_der_identity(spark):
    ref, hyp = segs(spark, ("A", 0, 10), ("B", 8, 12)), segs(spark, ("A", 1, 9), ("C", 8, 14))
    r = metrics.der(ref, hyp).first()
    assert (r.ref_us, r.miss_us, r.fa_us, r.conf_us) == (14 * S, 2 * S, 2 * S, 4 * S)
    pairs = {(x.speaker, x.r_speaker): x.shared_us for x in metrics.speaker_mapping(ref, hyp, ["file_id"]).collect()}
    assert pairs == {("A", "A"): 8 * S, ("C", "B"): 4 * S}


@pytest.mark.parametrize(
    "inputs,score",
    [((1, 1, 1, 36.00), 0.8320), ((1, 1, 0.615, 36.85), 0.8872), ((1, 1, 1, 32.17), 0.8435), ((1, 0.5, 1, 34.33), 0.6620), ((1, 1, 1, 33.20), 0.8404)],
)
def test_quality_score(spark, inputs, score):
    row = spark.createDataFrame([tuple(map(float, inputs))], "s double, e double, g double, w double")
    assert abs(row.select(scalars.quality_score(*map(F.col, "segw"))).first()[0] - score) < 1.01e-4


def seg(a, b, who="A", words="x"):
    return folds.Seg(int(a * S), int(b * S), who, words)


def test_folds():
    spec = folds.ChunkSpec()
    out = folds.merge_short([seg(0, 1), seg(1.2, 5), seg(9, 9.5, "B")], spec)
    assert [(s.start // S, s.end // S) for s in out] == [(0, 5), (9, 9)]
    chunks = folds.build_chunks([seg(0, 5, words="a b"), seg(6, 10, words="c"), seg(10.1, 50, "B", " ".join("w" * 40))], spec, [])
    assert chunks[0].text == "a b c" and sum(s.end - s.start for s in chunks[1:]) == int(39.9 * S)
    blocked = folds.greedy_chunks([seg(0, 5), seg(6, 10)], spec, [(int(5.2 * S), int(5.5 * S), "B")])
    assert len(blocked) == 2
    assert len(folds.merge_adjacent_speaker([seg(0, 5), seg(3, 8), seg(7, 9, "B"), seg(7.5, 10)])) == 3
    turns = folds.turn_groups([seg(0, 2, words="Hello"), seg(2.1, 3, words="There"), seg(3.1, 4, "B", "yes")])
    assert [t.text for t in turns] == ["Hello. There", "yes"]
    # A kept row shadows its copies, but a chain is not closed through a dropped one.
    rows = [seg(0, 10), seg(0.25, 10.25), seg(0.5, 10.5)]
    assert len(folds.drop_near_copies(rows, iou=2)) == 2
    assert len(folds.drop_repeated_lines([seg(0, 1, words="a b c"), seg(0.2, 1.2, words="a b c")])) == 1
    assert folds.capped_use([("1", ["u"]), ("2", ["u"]), ("3", ["u"]), ("4", [])]) == ["1", "2", "4"]
    assert folds.retime([(0, 2 * S, 2 * S), (4 * S, 6 * S, S), (5 * S, 6 * S, S)]) == [(0, 2 * S), (2_900_000, 3_900_000), (3_400_000, 4_400_000)]


def test_word_times():
    w = folds.clean_word_times([folds.Seg(a, b, "", "w") for a, b in [(0.0, 0.01), (0.005, 4.0), (6.0, 5.5)]])
    assert all(0.05 <= s.end - s.start <= 2.0 for s in w)
    assert all(a.end <= b.start for a, b in zip(w, w[1:], strict=False))
    assert folds.clean_word_times([]) == []


def test_readers_skip_what_does_not_fit(spark):
    lines = spark.createDataFrame([("SPEAKER rec1 1 20.706 74.233 <NA> <NA> spk_05 <NA> <NA>",), ("SPEAKER rec1 1 96.000 48.000 <NA> <NA> spk_05 <NA>",), ("SPEAKER rec1 1 96.000 48.000 <NA> <NA>",), (";; x",), ("SPEAKER r 1 bad 1 <NA> <NA> s",), (None,)], "value string")
    assert sorted((r.start_us, r.end_us) for r in readers.rttm(lines).collect()) == [(20_706_000, 94_939_000), (96_000_000, 144_000_000)]
    stm = spark.createDataFrame([("rec1 1 spk_05 20.706 24.000 <o,f0,unk> xin chao",), ("rec1 1 spk_05 20.706 24.000 XIN CHAO",), ("rec1 1 s 3 2 a b",), ("rec1 1 s 3",)], "value string")
    assert sorted(r.text for r in readers.stm(stm).collect()) == ["XIN CHAO", "xin chao"]
    assert sorted(r.text for r in readers.stm(stm, has_label=True).collect()) == ["CHAO", "xin chao"]


def test_write_and_read_rttm(spark, tmp_path):
    s = segs(spark, ("A", 0.5, 2), ("B", 1, 3))
    sinks.write_lines(sinks.rttm_lines(s), f"{tmp_path}/out")
    back = readers.rttm(readers.read_lines(spark, f"{tmp_path}/out").select("value"))
    assert sorted((r.start_us, r.end_us, r.speaker) for r in back.collect()) == [(500_000, 2_000_000, "A"), (1_000_000, 3_000_000, "B")]
    assert "| A |" in sinks.markdown_table(s.select("speaker").orderBy("speaker"))


def test_nfc(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r[0] for r in df.select(text.nfc("t")).collect()] == ["é", None]


def test_streams(spark, tmp_path):
    from turnlake.streaming import windows

    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*3) as t, id % 2 as k from range(10)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, k long").parquet(f"{tmp_path}/in")
    for name, df in (("sessions", windows.speech_sessions(stream, "t", ["k"], "7 seconds")), ("slides", windows.sliding_counts(stream, "t", ["k"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "slides" else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("slides").agg(F.max("n_events")).first()[0] >= 1
