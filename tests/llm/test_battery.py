"""The randomness battery against a plain version, over planted and ordinary runs, and its places."""

import math
import random
import re
import time

import pytest

from test_secret_kinds import HEX, LETTERS, LOWER, SCHEMA, WORDS
from tests_llm_brute import brute_base

from turnlake.llm import secret_scan as S


def phi(z):
    return 1 / (1 + math.exp(-max(-600, min(600, 1.5976 * z + 0.070566 * z**3)))) if abs(z) < 200 else float(z > 0)


def core(run):
    whole = re.sub(r"[-_=/+]", "", re.sub("^0[xX]", "", run))
    bare = re.sub(r"[-_=/+]", "", re.sub(r"^([A-Za-z]{1,10}[-_])*(0[xX])?", "", run))
    return whole if re.search(S.HEX_ONLY, whole) or len(bare) < S.CORE_LEAST else bare


def p_value(run):
    m = core(run)
    n = len(m)
    if n < S.CORE_LEAST:
        return 1.0
    k = 16 if re.search(S.HEX_ONLY, m) else 32 if re.search("^[A-Z2-7]+$", m) else 36 if re.search("^([0-9a-z]+|[0-9A-Z]+)$", m) else 62
    chi = k * sum(m.count(x) ** 2 for x in set(m)) / n - n
    if phi((1 - 2 / (9 * (k - 1)) - (chi / (k - 1)) ** (1 / 3)) / math.sqrt(2 / (9 * (k - 1)))) < S.UNIFORM_LEAST:
        return 1.0
    kind = ["lower" if x.islower() else "upper" if x.isupper() else "digit" for x in m]
    changes = sum(a != b and not (a == "upper" and b == "lower") for a, b in zip(kind, kind[1:])) / (n - 1)
    c = [ord(x) for x in m]
    mu = sum(c) / n
    serial = sum((a - mu) * (b - mu) for a, b in zip(c, c[1:])) / max(1.0, sum((x - mu) ** 2 for x in c))
    usual = k * (S.IC_TEXT * (1.8 if k == 16 else 1) * (n - 1) + 1) - n
    spread = k * (n - 1) * math.sqrt(2 / (n * (n - 1)) * (S.IC_TEXT - S.IC_TEXT**2 + 2 * (n - 2) * (S.CUBE_TEXT - S.IC_TEXT**2)))
    q = max(1e-300, phi((chi - usual) / spread) * phi((S.CHANGE_TEXT - changes) / math.sqrt(S.CHANGE_TEXT * (1 - S.CHANGE_TEXT) / (n - 1))) * phi((abs(serial) - S.SERIAL_TEXT) * math.sqrt(n)))
    return q * (1 - math.log(q) + math.log(q) ** 2 / 2)


def candidates(text, base):
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        free = [not any(s <= k < e for s, e in base) for k in range(m.start(), m.end())]
        for g in re.finditer("1{%d,}" % S.RUN_LEAST, "".join("01"[f] for f in free)):
            out.append((m.start() + g.start(), m.start() + g.end()))
    return out


def spans(text):
    """Spans of the battery, by plain steps."""
    base = []
    for pattern, least in ((S.ASSIGN, 0), (S.ACCESS, 20), (S.HEX, 24)):
        for m in re.finditer(pattern, text):
            if pattern != S.ASSIGN or len(re.sub(S.ASSIGN_HEAD, "", m[0])) >= S.ASSIGN_LEAST:
                base.append((m.start(), m.end()))
    runs = candidates(text, base)
    if not runs:
        return []
    weight = [min(2, (e - s) / 32) for s, e in runs]
    mean = sum(weight) / len(weight)
    tested = sorted((p_value(text[s:e]) * mean / w, s, e) for (s, e), w in zip(runs, weight))
    last = max((k for k, x in enumerate(tested, 1) if x[0] <= S.FDR * k / len(tested)), default=0)
    return sorted((s, e) for _, s, e in tested[:last])


def made(rng):
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = [
        lambda: pick(HEX.upper(), rng.randrange(20, 50)),
        lambda: "sk_live_" + pick(LETTERS + "0123456789", 24),
        lambda: pick(LOWER, rng.randrange(18, 40)),
        lambda: pick(LETTERS + "0123456789+/", 44) + "=",
        lambda: "_".join(rng.choice(WORDS) for _ in range(4)),
        lambda: "".join(rng.choice(WORDS).title() for _ in range(3)),
        lambda: pick(HEX, 30) + "Zq" + pick(LETTERS + "0123456789", 40),
        lambda: "token=" + pick(LETTERS, 9) + " " + pick(LETTERS + "0123456789", 30),
        lambda: pick(LETTERS + "0123456789", 30) + "password=\"" + pick(LETTERS, 12),
        lambda: "AKIA" + pick(HEX.upper(), 18) + "/" + pick(LETTERS + "0123456789", 33),
        lambda: "-" * 30,
        lambda: "é\U0001f600",
    ]
    return " ".join(rng.choice(kinds)() for _ in range(rng.randrange(7)))


def test_battery_equals_plain_steps(spark):
    rng = random.Random(11)
    texts = [made(rng) for _ in range(700)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    differ = 0
    for k, text in enumerate(texts):
        mine = [tuple(map(int, x.split(":")[1:])) for x in got[k].spans.split(",") if x.startswith("random")]
        assert got[k].base_sha256 == brute_base(text)[3]
        differ += mine != spans(text)
    assert differ == 0
    assert sum(r.n_random for r in got.values()) > 300


def test_rates_of_finding(spark):
    """Shares of planted random keys found and of ordinary runs taken for random, one run a text."""
    rng = random.Random(12)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    planted = [pick(LETTERS + "0123456789", 32) for _ in range(300)] + [pick(HEX.upper(), 40) for _ in range(300)]
    ordinary = ["_".join(rng.choice(WORDS) for _ in range(4)) for _ in range(300)] + ["".join(rng.choice(WORDS).title() for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(k, f"see {r} end") for k, r in enumerate(planted + ordinary)], SCHEMA)
    n = {r.doc_id: r.n_random for r in S.scan(df).collect()}
    assert sum(n[k] for k in range(600)) / 600 > 0.95 and sum(n[k] for k in range(600, 1200)) / 600 < 0.02


def test_many_matches_in_one_text_take_linear_time(spark):
    text = "token=abcdef12 " * 20_000
    df = spark.createDataFrame([(1, text), (2, "x")], SCHEMA)
    S.scan(df).collect()
    began = time.time()
    row = {r.doc_id: r for r in S.scan(df).collect()}[1]
    assert row.n_assign == 20_000 and row.base_sha256 == brute_base(text)[3] and time.time() - began < 5


def masked(text, spans):
    """The text with every stretch of spans that overlap replaced; spans that touch are two stretches."""
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + S.MASK
        at = max(at, b)
    return out + text[at:]


def test_masks_equal_plain_steps(spark):
    rng = random.Random(13)
    texts = [made(rng) for _ in range(300)] + [None, "", "\U0001f600 token=abcdef12\U0001f600é"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    spans = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in S.scan(df).collect()}
    for r in S.redact(df).collect():
        assert r.text == (masked(texts[r.doc_id], spans[r.doc_id]) if texts[r.doc_id] else texts[r.doc_id])


@pytest.mark.parametrize("kind", ["spaced", "in one run", "with gaps to test"])
def test_forty_thousand_matches_take_seconds(spark, kind):
    n = 40_000
    hexes = "0123456789abcdef01234567"
    text = {"spaced": "token=abcdef12 é " * n, "in one run": (hexes + "Z") * n, "with gaps to test": (hexes + "Zq" * 13) * (n // 2)}[kind]
    df = spark.createDataFrame([(1, text), (2, "x")], SCHEMA)
    for f in (S.scan, S.redact):
        f(df.where("doc_id = 2")).collect()
        began = time.time()
        row = {r.doc_id: r for r in f(df).collect()}[1]
        assert time.time() - began < 15
        if f is S.scan:
            assert max(row.n_assign, row.n_hex) in (n, n // 2) and row.base_sha256 == brute_base(text)[3]
        else:
            assert row.text.count(S.MASK) in (n, n // 2) and "abcdef" not in row.text
