"""The digest of the mix comes from its draws, and its copies equal plain loops over blocks and quotas."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from turnlake.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_digest_sums_the_draws(spark):
    rows = [(k, "w " * (k % 9), "abc"[k % 7 % 3]) for k in range(3000)] + [(1, "a b", "d"), (1, "a b", "d"), (2, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, drawn = mixing.digest(df).collect(), mixing.mix(df).collect()
    plan, _ = mixing.plan(df)
    want = Counter((r.id, r.size, r.source_size, r.taken, r.copies) for r in plan.collect())
    assert Counter((r.doc_id, r.size, r.source_size, r.taken, r.copies) for r in got) == want and len(got) == len(rows)
    places = [(s, p) for r in got for s, p in zip(r.shards, r.positions, strict=True)]
    assert all(len(r.shards) == r.copies for r in got)
    assert sorted(places) == sorted((r.shard, r.position) for r in drawn) and len(set(places)) == len(places)
    by = Counter(s for s, _ in places)
    assert len(by) >= mixing.SHARDS / 2 and all((s, n) in set(places) for s, n in by.items())


def test_shards_grow(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "'a b' as text", "cast(id % 2 as string) as source")
    _, draws = mixing.plan(df)
    assert draws.select("shard").distinct().count() > mixing.SHARDS


def plain_taken(rows, block):
    """Copies of every row (id, text, source) by plain loops: blocks of a source in permuted order while they fit into
    the rest of its target, then the documents of the next one in order of their second hash."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(*parts):
        h = 42
        for p in parts:
            if p is not None:
                h = xxhash.xxh64_intdigest(p, h)
        return h

    long = lambda x: None if x is None else (x & (1 << 64) - 1).to_bytes(8, "little")
    by, words = defaultdict(list), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for k, (i, t, s) in enumerate(rows):
        text = chain(None if t is None else t.encode())
        hashed = chain(long(i), long(text), mixing.SEED.to_bytes(4, "little"))
        within = chain(long(i), long(text), (mixing.SEED + 1).to_bytes(4, "little")) >> 2
        by[s].append((k, i, words(t), signed(hashed), within))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[2] for d in by[s]) for s in order]
    goal = mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(order))])
    out = [0] * len(rows)
    for n, s in enumerate(order):
        docs = by[s]
        parts = max(1, min(-(-len(docs) // block), mixing.ALL_BLOCKS * len(docs) // len(rows)))
        passes = int(goal[n] // sizes[n]) if sizes[n] else 0
        rest = round(goal[n] - passes * sizes[n])
        blocks = defaultdict(list)
        for d in docs:
            blocks[d[3] % parts].append(d)
            out[d[0]] = passes
        for b in np.random.default_rng([mixing.SEED, n]).permutation(parts).tolist():
            size = sum(d[2] for d in blocks[b])
            if size <= rest:
                for d in blocks[b]:
                    out[d[0]] += 1
                rest -= size
                continue
            end = sorted(blocks[b], key=lambda d: (d[4], -d[2], d[1] is not None, d[1] or 0))
            lo, hi = 0, 1 << 62
            while rest and sum(lo <= d[4] < hi for d in end) > block:
                width = max(1, -(-(hi - lo) // mixing.BINS))
                cells = defaultdict(list)
                for d in end:
                    if lo <= d[4] < hi:
                        cells[(d[4] - lo) // width].append(d)
                at, to, held = hi, hi, 0
                for c in sorted(cells):
                    if held:
                        if held + len(cells[c]) > block:
                            break
                        held, to = held + len(cells[c]), lo + (c + 1) * width
                    elif sum(d[2] for d in cells[c]) > rest:
                        at, to, held = lo + c * width, lo + (c + 1) * width, len(cells[c])
                    else:
                        rest -= sum(d[2] for d in cells[c])
                lo, hi = at, min(hi, to)
                if width == 1:
                    break
            for d in end if rest or lo else []:
                if d[4] < lo:
                    out[d[0]] += 1
                elif d[4] < hi and d[2] and d[2] <= rest:
                    out[d[0]] += 1
                    rest -= d[2]
            break
    return out


@pytest.mark.parametrize("block", [256, 8, 3])
def test_copies_equal_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice([k, k, None]), rng.choice([None, "", "w " * rng.randrange(1, 60)]) if k % 9 == 0 else f"t{k} " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = Counter((r.doc_id, r.size, r.source_size, r.copies) for r in mixing.digest(df).collect())
    sizes = Counter()
    size = lambda t: len((t or "").split())
    for _, t, s in rows:
        sizes[s] += size(t)
    want = Counter((i, size(t), sizes[s], n) for (i, t, s), n in zip(rows, plain_taken(rows, block)))
    assert got == want
