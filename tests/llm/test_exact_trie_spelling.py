"""Exact dedup, prefix trie and spelling variants against brute force and SQL, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from turnlake.llm import exact, prefix_trie, spelling
from turnlake.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    want = sorted(map(tuple, want.fetchall()), key=key)
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == want and want


# Exact dedup


def brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        g = sorted(by[norm(t)])
        out.append((i, None if g[0][1] else g[0][2], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=key), len(by)


def made_texts(rng, n):
    words = ["a", "bb", "ç", "\U0001f600", "x" * 7, "yz"]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = rng.choice(pool)
        t = rng.choice([t, t.replace(" ", "\n"), t.replace(" ", ""), t + "\t", t + "q", "z" + t, t + " "])
        out.append((i if rng.random() < 0.9 else None, rng.choice([t, t, t, None, "", " \x0b"])))
    return out


@pytest.mark.parametrize("block,bits", [(4096, 64), (5, 64), (3, 2)])
def test_groups_equal_brute_force(spark, block, bits):
    """Small blocks give several levels; few bits of the hash force the way by whole blocks."""
    rows = made_texts(random.Random(block * 100 + bits), 300)
    got = exact.duplicates(spark.createDataFrame(rows, DOCS).repartition(5), block=block, bits=bits).collect()
    want, groups = brute_groups(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == want
    assert sum(r.kept for r in got) == groups


def test_names_are_dense_and_sorted(spark):
    df = spark.createDataFrame([(k * 7919 % 1009, "x") for k in range(1, 1009)], "a long, b string")
    named = exact.sorted_names(df.repartition(7), ["a"], 100).orderBy("a").collect()
    assert [r.name for r in named] == list(range(100, 100 + 1008))


def test_one_changed_letter_of_a_long_text(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefg \n") for _ in range(300_000))
    other = base[:150_001] + ("h" if base[150_001] != "h" else "a") + base[150_002:]
    rows = [(1, base), (2, other), (3, base.replace("\n", "  ")), (4, base + base)]
    got = {r.doc_id: r for r in exact.duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].group_size, got[2].group_size, got[3].group_size, got[4].group_size) == (2, 1, 2, 1)
    assert got[1].keep_id == got[3].keep_id == 3 and got[3].kept and not got[1].kept


def test_keep_first_of_clashing_columns(spark):
    rows = [(2, "a b", 9, "u"), (1, "ab", 8, "v"), (None, "ab ", 7, "w"), (3, None, 6, "x"), (3, None, 6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid long, name string").withColumn("row", F.lit(1))
    got = exact.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.rid, r.name) for r in got.collect()) == [(2, "a b", 9, "u"), (3, None, 6, "x")]
    assert exact.keep_first(df.limit(0)).count() == 0 and exact.duplicates(df.limit(0)).count() == 0


def test_exact_has_no_python(spark, data):
    plan = exact.duplicates(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, v in convs.items()}
    trunc = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(trunc(c), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    saved, leaves = Counter(), Counter()
    for k, members in nodes.items():
        own_saved = (len(members) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += kids[k] == 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def made_turns(rng, n):
    rows = []
    for c in range(-12, n):
        if rng.random() < 0.15:
            continue
        same = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 7, 12, 25])):
            text = f"t{turn % 3}" if same and rng.random() < 0.95 else rng.choice(["", None, "é", "longer text", "x"])
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", "user", None]), text))
    rng.shuffle(rows)
    return rows + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("seed,stretch", [(1, 4096), (2, 3), (3, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, stretch):
    """Short stretches force running values over several of them."""
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "RANGE", 20)
    rows = made_turns(random.Random(seed), 150)
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(6))
    assert sorted(map(tuple, got.collect()), key=key) == brute_trie(rows)


def test_deep_and_hot(spark):
    """A conversation with a third of all turns, and a third of all conversations the same."""
    rows = [(5, k, "user", f"t{k}") for k in range(150)] + [(5 * k, t, "user", "hello") for k in range(2, 60) for t in range(2)]
    rows += [(5 * k, 0, "a", f"own {k}") for k in range(60, 180)]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    assert sorted(map(tuple, got), key=key) == brute_trie(rows)


def test_trie_edge_cases(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(none).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "u", "x")], TURNS)).count() == 0
    for rows in ([(7, None, None, None)], [(7, 0, "u", "x"), (7, 0, "u", "x")], [(3, 0, "u", "x"), (4, 0, "u", "x"), (0, 1, "v", "y")]):
        df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit("clash")).withColumn("c", F.lit(2)).withColumn("d", F.lit(1))
        assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=key) == brute_trie(rows)


# Spelling variants


def brute_variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=key)


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    pick = lambda: "".join(rng.choice("abÀéA") for _ in range(rng.randrange(4, 8)))
    pool = [pick() for _ in range(150)] + ["aaaaa", "aaaaaa", "aabaaa", "×" * 6]
    rows = [(rng.choice([k, None, 3]), rng.choice([" ".join(rng.choices(pool, [1 + (k % 7) ** 3 for k in range(len(pool))], k=rng.randrange(40))) + rng.choice(["", "5", "_Ā"]), None, ""])) for k in range(250)]
    rows += [(1000 + k, "qwerty qwertyu qwertyui " * (2**j)) for j in range(2) for k in range(2)] + [(2000, "qwertyu " * 20 + "qwertyui " * 60)]
    got = spelling.variants(spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("clash")).repartition(4))
    want = brute_variants(rows)
    assert sorted(map(tuple, got.collect()), key=key) == want and sum(r[4] for r in want) > 20 and any(r[1] and r[1] != r[2] for r in want)
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_over_pieces(monkeypatch):
    rng = random.Random(6)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(spelling, "PIECE", piece)
        for _ in range(100):
            low = "".join(rng.choice("ab é÷ā中\U0001f600\u0083Ã") for _ in range(rng.randrange(60))).encode()
            assert [r for rs in spelling._runs(low) for r in rs] == spelling.RUN.findall(low)


def test_keys_meet_iff_one_apart():
    """Keys alone (without the check of strings) already give the pairs: no collision in a small vocabulary."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(300)})
    keys, index, kind = spelling.keys_of(words)
    by = defaultdict(list)
    for k, i, t in zip(keys.tolist(), index.tolist(), kind.tolist()):
        by[k].append((i, t))
    pairs = Counter()
    for members in by.values():
        for x in range(len(members)):
            for y in range(x):
                (i, s), (j, t) = members[x], members[y]
                if s == t == 0 or {s, t} == {1, 2}:
                    pairs[frozenset((i, j))] += 1
    want = {frozenset((i, j)) for i in range(len(words)) for j in range(i) if spelling.one_apart(words[i], words[j])}
    assert set(pairs) == want and set(pairs.values()) == {1}


def test_long_words_cost_their_length(spark):
    """Two words of 200,000 letters that differ by one, three times each."""
    a = "ab" * 100_000
    b = a[:70_001] + "c" + a[70_002:]
    rows = [(k, f"{a} {b} {b}") for k in range(3)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, DOCS)).collect() if len(r.word) == 200_000}
    assert (got[a].n, got[a].n_near, got[a].form) == (3, 1, b) and (got[b].n, got[b].form) == (6, None)
