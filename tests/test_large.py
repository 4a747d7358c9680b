"""Operators for recordings, groups and streams of any size: slices, ranges, components, ledgers, trees."""

import json
import os
import random
import statistics
import time
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnlake.operators import aggregates, dedup, folds, graph, intervals, metrics, shared, sweep, vectors
from turnlake.registry import QUERIES
from turnlake.sources import readers, scans, tree
from turnlake.streaming import progress

S = 1_000_000


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((v is None, v) for v in r))


def test_slices_equal_whole_windows(spark):
    """Long segments over many slices, ties, touching ends, a null key and slices without a start."""
    rng = random.Random(1)
    made = []
    for k in range(900):
        a = rng.randrange(0, 7200 * S, 500_000)
        made.append((k, rng.choice(["f", "g", None]), rng.choice("AB"), a, a + rng.choice([500_000, 500_000, 60 * S, 1500 * S])))
    df = spark.createDataFrame(made, "seg_id long, file_id string, speaker string, start_us long, end_us long")
    for slice_us in (60 * S, 3600 * S):
        for f, columns in ((intervals.islands, ("file_id", "start_us", "end_us", "n_segments")), (intervals.steps, ("file_id", "start_us", "end_us", "active")), (intervals.time_profile, ("file_id", "silence_us", "single_us", "overlap_us", "max_active"))):
            assert rows(f(df, slice_us=slice_us), *columns) == rows(f(df), *columns)
        assert rows(aggregates.fairness_weights(df, slice_us=slice_us), "seg_id", "weight") == rows(aggregates.fairness_weights(df), "seg_id", "weight")
    assert rows(intervals.islands(df, gap_us=2 * S, slice_us=60 * S), "file_id", "start_us", "end_us") == rows(intervals.islands(df, gap_us=2 * S), "file_id", "start_us", "end_us")
    assert intervals.islands(df.limit(0), slice_us=S).count() == 0


def test_numbers_and_quantiles(spark):
    rng = random.Random(2)
    made = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, rng.random()]), k) for k in range(2000)] + [("c", None, 1), ("d", 4.0, 2)]
    df = spark.createDataFrame(made, "g string, v double, k long").repartition(7)
    by = defaultdict(list)
    for g, v, k in made:
        by[g].append((v is not None, v or 0, k))
    got = {(r.g, r.v, r.k): r.n for r in shared.numbered(df, ["g"], ["v", "k"], "n").collect()}
    assert all(got[g, v if some else None, k] == n for g in by for n, (some, v, k) in enumerate(sorted(by[g])))
    middle = {r.g: r.median for r in aggregates.spread(df, ["g"], "v").collect()}
    for g, vs in by.items():
        known = [v for some, v, _ in vs if some]
        assert middle[g] == (pytest.approx(statistics.median(known)) if known else None)
    low = {r.g: r.q for r in aggregates.quantile(df, ["g"], "v", 0.1, "q").collect()}
    assert low["a"] == pytest.approx(float(np.quantile([v for some, v, _ in by["a"] if some], 0.1))) and "c" not in low


def test_components_of_a_graph(spark):
    rng = random.Random(3)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("hub", f"s{k}") for k in range(60)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(50)] + [("x", "x")]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            m = todo.pop()
            if m not in want:
                want[m] = n
                todo += near[m]
    got = graph.components(spark.createDataFrame(edges, "u string, v string"))
    assert rows(got, "node", "root") == sorted(want.items())
    assert graph.components(spark.createDataFrame([], "u string, v string")).count() == 0


@pytest.mark.parametrize("seed,unit_rounds,unit_rows", [(1, 3, 10**6), (2, 1, 10**6), (3, 1, 5)])
def test_capped_rows_equal_the_fold(spark, monkeypatch, seed, unit_rounds, unit_rows):
    """Chains of units need rounds, components or both; a row may have one, several, equal or no units."""
    monkeypatch.setattr(dedup, "UNIT_ROUNDS", unit_rounds)
    monkeypatch.setattr(dedup, "UNIT_ROWS", unit_rows)
    rng = random.Random(seed)
    made = []
    for k in range(150):
        u = rng.randrange(50)
        made.append((f"s{k}", rng.choice("xy"), rng.randrange(400), rng.choice([None, [], [f"u{u}"], [f"u{u}", f"u{u + 1}"], [f"u{u}", f"u{u + 1}", f"u{u + 2}", f"u{u}"]])))
    df = spark.createDataFrame(made, "id string, group string, place int, units array<string>")
    want = []
    for g in "xy":
        mine = sorted((p, i, sorted(set(us or []))) for i, gr, p, us in made if gr == g)
        want += [(i, g) for i in folds.capped_use([(i, us) for _, i, us in mine], 2)]
    assert rows(dedup.capped_rows(df, "id", ["place"]), "id", "group") == sorted(want)


def test_reuse_without_a_null_group(spark):
    df = spark.createDataFrame([(k, None if k % 3 else k % 2) for k in range(300)], "k int, unit int")
    got = dedup.limit_reuse(df, "unit", ["k"])
    assert sorted(r.k for r in got.collect()) == sorted([k for k in range(300) if k % 3] + [0, 3, 6, 9])
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def plain_der(ref, hyp, names):
    cuts = sorted({t for _, a, b in ref + hyp for t in (a, b)})
    out = [0, 0, 0, 0]
    for t0, t1 in zip(cuts, cuts[1:]):
        r = {s for s, a, b in ref if a <= t0 and t1 <= b}
        h = {s for s, a, b in hyp if a <= t0 and t1 <= b}
        hit = sum(names.get(x) in r for x in h)
        for k, v in enumerate((len(r), max(0, len(r) - len(h)), max(0, len(h) - len(r)), min(len(r), len(h)) - hit)):
            out[k] += v * (t1 - t0)
    return tuple(out)


def test_best_mapping_against_all_permutations(spark):
    """More and fewer hypothesis speakers than reference ones, labels that mislead, own overlaps, silence."""
    rng = random.Random(4)
    refs, hyps, want = [], [], {}
    for f in range(25):
        side = lambda names: [(rng.choice(names), a := rng.randrange(60), a + rng.randrange(1, 25)) for _ in range(rng.randrange(1, 9))]  # noqa: B023, E731
        ref, hyp = side("ABCD"[: rng.randrange(1, 5)]), side("BAxyz"[: rng.randrange(1, 6)])
        hyp = hyp if f else [("A", 100, 120)]
        refs += [(f"f{f}", *x) for x in ref]
        hyps += [(f"f{f}", *x) for x in hyp]
        rs, hs = sorted({s for s, _, _ in ref}), sorted({s for s, _, _ in hyp})
        slots = [*rs, *[None] * len(hs)]
        want[f"f{f}"] = min((plain_der(ref, hyp, dict(zip(hs, p))) for p in set(permutations(slots, len(hs)))), key=lambda t: t[3])
    schema = "file_id string, speaker string, start_us long, end_us long"
    got = metrics.der_mapped(spark.createDataFrame(refs, schema), spark.createDataFrame(hyps, schema))
    assert {r.file_id: (r.ref_us, r.miss_us, r.fa_us, r.conf_us) for r in got.collect()} == want


def test_long_alignments(monkeypatch):
    """Few columns are held, so the way back starts again from kept ones, over several levels."""
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(30))], [rng.choice("abc") for _ in range(rng.randrange(30))]) for _ in range(300)]
    whole = [metrics.back_trace(a, b) for a, b in pairs]
    for held, kept in ((1, 2), (2, 3), (3, 2)):
        monkeypatch.setattr(metrics, "HELD_COLUMNS", held)
        monkeypatch.setattr(metrics, "KEPT_COLUMNS", kept)
        assert [metrics.back_trace(a, b) for a, b in pairs] == whole
    monkeypatch.undo()
    import tracemalloc

    words = [str(rng.randrange(500)) for _ in range(20_000)]
    heard = [w if rng.random() < 0.8 else "x" for w in words if rng.random() < 0.9]
    tracemalloc.start()
    s, d, k = metrics.back_trace(words, heard)
    assert s + d + k == metrics.levenshtein(words, heard) and tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def plain_clean(rows, least):
    """rows: rec, id, vector, label. Plain loops over recordings: (member, dropped_in, assigned) by id."""
    out = {}
    cos = lambda a, b: float(a @ b) / (float(a @ a) * float(b @ b)) ** 0.5
    for rec in {r[0] for r in rows}:
        mine = {i: (v, label) for r, i, v, label in rows if r == rec}
        member, dropped = {i for i, (_, label) in mine.items() if label is not None}, {}
        for k in range(1, 100):
            middle = {label: np.mean([mine[i][0] for i in member if mine[i][1] == label], axis=0) for label in {mine[i][1] for i in member}}
            bad = {i for i in member if cos(mine[i][0], middle[mine[i][1]]) < least}
            if not bad:
                break
            member -= bad
            dropped |= dict.fromkeys(bad, k)
        for i, (v, label) in mine.items():
            near = label if i in member else mine[min(member, key=lambda j: (-round(cos(v, mine[j][0]), 9), j))][1] if member else None
            out[rec, i] = (i in member, dropped.get(i), near)
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_purified_vectors_equal_plain_loops(spark, data, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    made = []
    for r in pq.read_table(f"{data}/embeddings.parquet").to_pylist():
        i = r["vec_id"]
        label = None if i % 5 == 0 else (r["label"] + 1) % 10 if i % 7 == 0 else r["label"]
        made.append((i % 2, i, np.array(r["embedding"], np.float64), label))
    want = plain_clean(made, 0.5)
    got = {(r.rec, r.vec_id): (r.member, r.dropped_in, r.assigned) for r in QUERIES["met_purified"](spark, data).collect()}
    assert got == want and any(x[1] for x in want.values()) and len({x[1] for x in want.values()}) > 1


def test_vectors_without_members(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 2.0], None)], "vec_id int, embedding array<double>, label string").withColumn("rec", F.lit(0))
    state = vectors.purify(df, ["rec"], 0.5)
    assert rows(state, "vec_id", "member") == [(1, False), (2, False), (3, True), (4, False)]
    assert rows(vectors.propagate(state, ["rec"]), "vec_id", "assigned") == [(1, "b"), (2, None), (3, "b"), (4, "b")]
    none = vectors.purify(df.where("vec_id = 1"), ["rec"], 0.5)
    assert rows(vectors.propagate(none, ["rec"]), "vec_id", "assigned") == [(1, None)]


def test_a_stopped_run_goes_on(spark, tmp_path):
    """The run dies in the second part; the next one runs what the ledger lacks, and failures after the whole
    first pass."""
    log = tmp_path / "log"
    log.mkdir()

    def task(row, log=str(log)):
        n = len(os.listdir(log))
        open(f"{log}/{time.time_ns()}_{row['k']}", "w").close()
        if row["k"] % 10 == 0:
            raise ValueError(f"no {n > 0}")
        return f"ok {row['k']}"

    grid = spark.range(40).select(F.col("id").alias("k")).coalesce(1)
    path = f"file://{tmp_path}/ledger"
    real, calls = sweep.ledger, []

    def dies(*a):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(*a)

    sweep.ledger = dies
    try:
        with pytest.raises(RuntimeError, match="killed"):
            sweep.run_passes(grid, ["k"], task, path)
    finally:
        sweep.ledger = real
    before = {f.split("_")[1] for f in os.listdir(log)}
    assert 0 < len(before) < 40
    got = {r.k: (r.result, r.error, r.tries) for r in sweep.run_passes(grid, ["k"], task, path).collect()}
    runs = [f.split("_")[1] for f in sorted(os.listdir(log))]
    assert all(runs.count(str(k)) == (2 if k % 10 == 0 else 1) for k in range(40))
    assert set(runs[:40]) == set(map(str, range(40))) and set(runs[40:]) == {"0", "10", "20", "30"}
    assert got[7] == ("ok 7", None, 1) and got[10] == (None, "ValueError: no True", 2)


def test_progress_of_two_batches(spark, tmp_path):
    """The second batch has a repeated and a late line; the time left is that of a plain loop."""
    schema = "session string, stage string, ts timestamp, value string"
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    one = [("a", "der", 0, "start"), ("a", "der", 10, "PROGRESS:1/8"), ("a", "der", 20, "PROGRESS:2/8"), ("b", "asr", 5, "PROGRESS:0/3")]
    two = [("a", "der", 20, "PROGRESS:2/8"), ("a", "der", 15, "PROGRESS:1/8"), ("a", "der", 40, "noise"), ("a", "der", 45, "PROGRESS:3/8"), ("a", "asr", 50, "PROGRESS:x/8")]
    os.makedirs(f"{tmp_path}/in")
    lines = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for k, batch in enumerate((one, two)):
        with open(f"{tmp_path}/in/{k}.json", "w") as f:
            f.write("\n".join(json.dumps({"session": s, "stage": t, "ts": at(x), "value": v}) for s, t, x, v in batch))
        got = {(r.session, r.stage): (r.done, r.total, r.elapsed_us, r.left_us) for r in progress.run_progress(lines, f"file://{tmp_path}/out").collect()}
        best, start = {}, {}
        for s, t, x, v in sorted(one + two if k else one, key=lambda r: r[2]):
            start.setdefault((s, t), x)
            best.setdefault((s, t), (0, 0, 0, None))
            if v.startswith("PROGRESS:") and v[9].isdigit() and (int(v[9]) > best[s, t][0] or best[s, t][1] == 0):
                done, total = map(int, v[9:].split("/"))
                took = (x - start[s, t]) * S
                best[s, t] = (done, total, took, took * (total - done) // done if done else None)
        assert got == best


def test_tree_as_a_source(spark, tmp_path):
    tree.register(spark)
    for f, name, text in (("data1", "labeled/mixture.rttm", "SPEAKER x 1 0.5 1.0 <NA> <NA> A <NA> <NA>\r\nSPEAKER x 1 2 1 <NA> <NA> B <NA> <NA>"), ("data2", "mixture.rttm", "SPEAKER x 1 9 1 <NA> <NA> A <NA> <NA>\n"), ("file_id=data3", "a.stm", "é 1\n\n"), ("data4", "_hidden/x.rttm", "no"), (".git", "x", "no")):
        (tmp_path / f / name).parent.mkdir(parents=True)
        (tmp_path / f / name).write_bytes(text.encode())
    df = spark.read.format(tree.FORMAT).option("task_bytes", 60).load(str(tmp_path))
    assert rows(df, "file_id", "name", "line_no") == [("data1", "mixture.rttm", 0), ("data1", "mixture.rttm", 1), ("data2", "mixture.rttm", 0), ("data3", "a.stm", 0), ("data3", "a.stm", 1)]
    assert df.rdd.getNumPartitions() == 2
    turns = readers.rttm(df.where("name = 'mixture.rttm' and file_id in ('data1', 'data9')"), key="file_id")
    assert rows(turns, "file_id", "start_us", "speaker") == [("data1", S // 2, "A"), ("data1", 2 * S, "B")]
    # Files of other folders are not opened: one that cannot be read does no harm.
    os.chmod(tmp_path / "data2" / "mixture.rttm", 0)
    os.rename(tmp_path / "data2" / "mixture.rttm", tmp_path / "data2" / "gone.rttm")
    reader = tree.TreeReader(str(tmp_path), 1 << 20)
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    kept = list(reader.pushFilters([EqualTo(("file_id",), "data1"), IsNotNull(("file_id",)), StringStartsWith(("name",), "mix")]))
    assert [type(f) for f in kept] == [IsNotNull] and [f.file_id for p in reader.partitions() for f in p.files] == ["data1"]


def test_tree_as_a_stream(spark, tmp_path):
    tree.register(spark)
    source = tmp_path / "in"

    def put(f, n):
        (source / f).mkdir(parents=True)
        (source / f / "t.rttm").write_text("".join(f"SPEAKER x 1 {k} 1 <NA> <NA> A <NA> <NA>\n" for k in range(n)))

    def run():
        lines = spark.readStream.format(tree.FORMAT).option("settle_us", 0).load(str(source))
        q = readers.rttm(lines, key="file_id").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").groupBy("file_id").count().collect()

    put("data1", 3)
    time.sleep(0.1)
    assert {r.file_id: r["count"] for r in run()} == {"data1": 3}
    put("data2", 2)
    time.sleep(0.1)
    assert {r.file_id: r["count"] for r in run()} == {"data1": 3, "data2": 2}


@pytest.mark.parametrize("fixed,source,tiers", [(False, "vivos", {"tier_A_0pct", "tier_D_20_30pct"}), (True, "vivos", {"tier_A_0pct"}), (False, "self_labeled", {"self_labeled"})])
def test_tiers_of_sessions(spark, fixed, source, tiers):
    recordings = spark.createDataFrame([(f"d{k}", "w", "r", S, None) for k in range(4)], "file_id string, wav_path string, rttm_path string, duration_us long, enrollment_dir string")
    turns = spark.createDataFrame([(f"d{k}", "A") for k in range(4)], "file_id string, speaker string")
    overlaps = spark.createDataFrame([("d1", 25, 3, 1)], "name string, overlap int, n_speakers int, episode int")
    got = scans.sessions(recordings, turns, overlaps, source, fixed_tier=fixed).collect()
    assert {r.source for r in got} == tiers and {r.file_id: r.n_speakers for r in got}["d1"] == 3
