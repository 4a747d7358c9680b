"""Queries without SQL against plain versions over the same tables: no operator of the package is used to
make what is expected."""

import math
import struct
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import pyarrow.parquet as pq
import pytest
import xxhash

from turnlake.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def events(data):
    """(file, seg_id, speaker, start, end) of every event."""
    out = []
    for r in pq.read_table(f"{data}/events.parquet").to_pylist():
        us = (r["ts"].replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        out.append((str(r["ts"].date()), r["event_id"], str(r["user_id"] % 4), us, us + math.floor(r["value"] * 100 + 0.5) * 10_000))
    return out


@pytest.fixture(scope="module")
def turns(data):
    """(conversation, turn, role, words, start, end) of every turn with words."""
    by, out = defaultdict(list), []
    for r in pq.read_table(f"{data}/conversations.parquet").to_pylist():
        by[r["conv_id"]].append(r)
    for c, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["turn"]):
            words = (r["text"] or "").lower().split()
            if words:
                out.append((c, r["turn"], r["role"], words, at, at + len(words) * 400_000))
            at += len(words) * 400_000
    return out


def files(rows):
    by = defaultdict(list)
    for f, n, who, a, b in rows:
        by[f].append((a, b, n, who, f"w{n % 5}"))
    return {f: sorted(r) for f, r in by.items()}


def result(spark, data, name):
    by = defaultdict(list)
    for r in QUERIES[name](spark, data).collect():
        by[r.file_id].append((r.n, r.start_us, r.end_us, r.speaker, r.text))
    return {f: [x[1:] for x in sorted(r)] for f, r in by.items()}


def test_these_are_all():
    mine = "met_word_errors met_speaker_mapping met_compression_ratio smp_with_replacement fold_chunks fold_merge_short fold_merge_adjacent fold_turn_groups fold_near_copies fold_repeated_lines fold_retime fold_word_times dd_capped_use scan_samples scan_partitions met_purified"
    assert set(QUERIES) - set(ORACLE_SQL) == set(mine.split())


def plain_short(rows):
    rows, out, k = [list(r) for r in rows], [], 0
    while k < len(rows):
        a, b, who, text = rows[k]
        reach = lambda gap, x, y: gap <= 500_000 and ((x == y and x != "") or gap <= 250_000)
        if b - a < 2_500_000:
            if k + 1 < len(rows) and reach(rows[k + 1][0] - b, who, rows[k + 1][2]):
                rows[k + 1] = [a, rows[k + 1][1], who or rows[k + 1][2], f"{text} {rows[k + 1][3]}"]
                k += 1
                continue
            if out and reach(a - out[-1][1], out[-1][2], who):
                out[-1] = [out[-1][0], b, out[-1][2] or who, f"{out[-1][3]} {text}"]
                k += 1
                continue
        out.append([a, b, who, text])
        k += 1
    return [tuple(r) for r in out]


def plain_chunks(rows, turns):
    out = []
    for a, b, who, text in plain_short(rows):
        if out:
            p = out[-1]
            gap, same = a - p[1], p[2] == who
            alone = not any(s < a and e > p[1] and w != p[2] for s, e, w in turns)
            if b - p[0] <= 18_000_000 and (gap <= 500_000 and (same or gap <= 200_000) or 500_000 < gap <= 1_500_000 and same and alone):
                out[-1] = (p[0], b, p[2], f"{p[3]} {text}")
                continue
        out.append((a, b, who, text))
    cut = []
    for a, b, who, text in out:
        n, words = max(1, -(-(b - a) // 30_000_000)), text.split()
        step = max(1, len(words) // n)
        for k in range(n):
            mine = words[k * step :] if k == n - 1 else words[k * step : k * step + step]
            cut.append((a + (b - a) * k // n, a + (b - a) * (k + 1) // n, who, " ".join(mine) or text))
    return cut


def test_chunks(spark, data, events):
    short, chunks = result(spark, data, "fold_merge_short"), result(spark, data, "fold_chunks")
    for f, rows in files(events).items():
        lines = [(a, b, who, t) for a, b, _, who, t in rows]
        assert short[f] == plain_short(lines)
        assert chunks[f] == plain_chunks(lines, [(a, b, who) for a, b, who, _ in lines])


def test_adjacent_and_near_copies(spark, data, events):
    adjacent, copies = result(spark, data, "fold_merge_adjacent"), result(spark, data, "fold_near_copies")
    for f, rows in files(events).items():
        want, kept = [], []
        for a, b, _, who, t in rows:
            if want and want[-1][2] == who and a < want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], b), who, want[-1][3])
            else:
                want.append((a, b, who, t))
            near = [(p, q) for p, q, _, x in kept if x == t]
            iou = lambda p, q: max(0, min(q, b) - max(p, a)) / max(1, max(q, b) - min(p, a))  # noqa: B023, E731
            if not any(abs(p - a) <= 300_000 and abs(q - b) <= 300_000 or iou(p, q) >= 0.85 for p, q in near):
                kept.append((a, b, who, t))
        assert adjacent[f] == want and copies[f] == kept


def test_turn_groups(spark, data, turns):
    got, want = result(spark, data, "fold_turn_groups"), defaultdict(list)
    for c, _, who, words, a, b in turns:
        out, text = want[c], " ".join(words)
        if out:
            p = out[-1]
            ended = p[3][-1] in ".?!" and p[1] - p[0] > 4_000_000
            if p[2] == who and a - p[1] <= 1_200_000 and b - p[0] <= 10_000_000 and not ended:
                stop = "." if text[0].isupper() and p[3][-1] not in ".?!,:;" else ""
                out[-1] = (p[0], b, who, f"{p[3]}{stop} {text}")
                continue
        out.append((a, b, who, text))
    assert got == want


def test_repeated_lines_and_capped_use(spark, data, turns):
    repeated, capped = result(spark, data, "fold_repeated_lines"), result(spark, data, "dd_capped_use")
    lines, own = defaultdict(list), defaultdict(list)
    for c, t, who, words, a, b in turns:
        own[c].append((a, b, t, who, words))
        lines[c].append((a, b, t, who, words))
        kept = [w for k, w in enumerate(words, 1) if k % 7]
        lines[c].append((a + 700_000, b + 700_000, c * 1000 + t, who, kept))
    for c in own:
        out = []
        for a, b, _, who, words in sorted(lines[c]):
            s = set(words)
            if not any(abs(p - a) + abs(q - b) < 1_000_000 and x and s and len(x & s) > 0.8 * max(len(x), len(s)) for p, q, x, _ in out):
                out.append((a, b, s, (a, b, who, " ".join(words))))
        assert repeated[c] == [o[3] for o in out]
        used, rest = Counter(), []
        for a, b, _, who, words in sorted(own[c]):
            units = {w for w in words if len(w) >= 5}
            if all(used[u] < 2 for u in units):
                used.update(units)
                rest.append((a, b, who, " ".join(words)))
        assert capped.get(c, []) == rest


def test_retimed_slots(spark, data, events):
    """Gaps before a slot that begins a group are 45 % of what they were; lengths are 80 %."""
    got = result(spark, data, "fold_retime")
    for f, rows in files(events).items():
        assert [g[1] - g[0] for g in got[f]] == [(b - a) * 8 // 10 for a, b, *_ in rows]
        end = made = 0
        for (a, b, *_), (x, y, *_) in zip(rows, got[f]):
            if a >= end - 1000:
                assert x == made + max(0, a - end) * 45 // 100
            end, made = max(end, b), max(made, y)


def test_relaxed_words(spark, data, turns):
    got = result(spark, data, "fold_word_times")
    assert {c: len(r) for c, r in got.items()} == Counter(t[0] for t in turns)
    for rows in got.values():
        assert all(50_000 <= b - a for a, b, *_ in rows) and all(p[1] <= q[0] for p, q in zip(rows, rows[1:]))


def test_word_errors(spark, data):
    from turnlake.plans.joins import assigned

    got = {r.hyp_id: (r.substitutions, r.deletions, r.insertions) for r in QUERIES["met_word_errors"](spark, data).collect()}
    pairs = assigned(spark, data).collect()
    assert set(got) == {r.hyp_id for r in pairs}
    for r in pairs:
        a, b = r.ref_words, r.words
        cost = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(cost[-1][j] + 1, row[-1] + 1, cost[-1][j - 1] + (x != y)))
            cost.append(row)
        s, d, k = got[r.hyp_id]
        assert s + d + k == cost[-1][-1] and d - k == len(a) - len(b)


def test_speaker_mapping(spark, data, events):
    got = defaultdict(list)
    for r in QUERIES["met_speaker_mapping"](spark, data).collect():
        got[r.file_id].append((r.speaker, r.r_speaker, r.shared_us))
    for f, rows in files(events).items():
        hyp = [(a + (n % 7 - 3) * 500_000, b + (n % 7 - 3) * 500_000, str((int(w) + 1) % 4) if n % 13 == 0 else w) for a, b, n, w, _ in rows if n % 11]
        shared = Counter()
        for a, b, w in hyp:
            for p, q, _, x, _ in rows:
                shared[w, x] += max(0, min(b, q) - max(a, p))
        best = max(sum(shared[str(i), str(x)] for i, x in enumerate(p)) for p in permutations(range(4)))
        mine = got[f]
        assert sum(x[2] for x in mine) == best and all(shared[x[0], x[1]] == x[2] for x in mine)
        assert len({x[0] for x in mine}) == len({x[1] for x in mine}) == len(mine)


def test_compression(spark, data):
    text = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    want = {i: bool(t) and len(t.encode()) / len(zlib.compress(t.encode())) > 2.4 for i, t in text.items()}
    assert {r.doc_id: r.repetitive for r in QUERIES["met_compression_ratio"](spark, data).collect()} == want


def test_draws(spark, data):
    source = {r["doc_id"]: r["source"] for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "source"]).to_pylist()}
    sizes, want = Counter(source.values()), Counter()
    for i, s in source.items():
        rate = 1000 / len(sizes) / sizes[s]
        parts = max(1, math.ceil(rate))
        for part in range(1, parts + 1):
            h = 42
            for x in (struct.pack("<q", i), struct.pack("<q", part), struct.pack("<i", 42)):
                h = xxhash.xxh64_intdigest(x, h)
            u, term = ((h >> 12) + 0.5) / 2**52, math.exp(-rate / parts)
            total, n = term, 0
            while u > total and n < 40:
                n += 1
                term *= rate / parts / n
                total += term
            want[i] += n
    assert Counter(r.doc_id for r in QUERIES["smp_with_replacement"](spark, data).collect()) == +want


def plain_samples(turns, cap):
    """Padded chunks of every conversation, near copies dropped, with overlap; at most cap of a unit."""
    by, out = defaultdict(list), []
    for c, t, who, words, a, b in turns:
        by[c].append((a, b, who, words))
    for c, rows in by.items():
        heard = sorted((a + 700_000, b + 700_000, who) for a, b, who, _ in rows)
        regions = []
        for a, b, _ in heard:
            if regions and a <= regions[-1][1] + 150_000:
                regions[-1][1] = max(regions[-1][1], b)
            else:
                regions.append([a, b])
        lines = []
        for a, b, who, words in rows:
            best = max(((min(b, q) - max(a, p), -p, max(a, p), min(b, q)) for p, q in regions if min(b, q) > max(a, p)), default=None)
            lines.append((*(best[2:] if best else (a, b)), who, words))
        full = max(b for _, b, _, _ in rows) + 1_000_000
        kept = []
        for a, b, who, text in plain_chunks(sorted((a, b, who, texts[c][k]) for k, (a, b, who, _) in enumerate(lines)), heard):
            a, b = max(0, a - 100_000), min(full, b + 200_000)
            iou = lambda p, q: max(0, min(q, b) - max(p, a)) / max(1, max(q, b) - min(p, a))  # noqa: B023, E731
            if b > a and not any(x == " ".join(text.split()) and (abs(p - a) <= 300_000 and abs(q - b) <= 300_000 or iou(p, q) >= 0.85) for p, q, x in kept):
                kept.append((a, b, " ".join(text.split())))
                out.append((f"data{c}", a, b, who, " ".join(text.split())))
    return out


texts: dict = {}


def test_samples_of_a_scan(spark, data, turns):
    for r in pq.read_table(f"{data}/conversations.parquet").to_pylist():
        if (r["text"] or "").split():
            texts.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    for c in texts:
        texts[c] = [t for _, t in sorted(texts[c])]
    every = plain_samples(turns, None)
    got = [(r.file_id, r.start_us, r.end_us, r.speaker, " ".join(r.text.split())) for r in QUERIES["scan_samples"](spark, data).collect()]
    assert set(got) <= set(every) and len(set(got)) == len(got)
    # Each unit stands for conversations of one number mod 40, so at most two samples of those are kept.
    unit = lambda f: int(f.removeprefix("data")) % 40
    used, offered = Counter(unit(g[0]) for g in got), Counter(unit(e[0]) for e in set(every))
    assert used == {u: min(2, n) for u, n in offered.items()}
    counts = {r.source_partition: r.samples for r in QUERIES["scan_partitions"](spark, data).collect()}
    assert counts == {"self_train": len(set(every)), "vivos_train": len(got)}
