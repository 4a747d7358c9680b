"""Secret scans: fixed patterns and a randomness test battery, in DataFrame operations only.

Base spans: three patterns, leftmost and non-overlapping per kind. Places come from the pieces between
matches: a match ends where the pieces and matches up to it do, counted in code points; those sums are
doubled up in rounds (n log n, nothing is copied match by match).

Battery: candidates are runs of 20 or more of [A-Za-z0-9+/_=-], and where base spans touch a run, what they
leave of it in stretches of 20 or more. Tested is a run's core: its segments between signs, joined, without
0x and without leading names such as sk- or sk_live_, unless fewer than CORE_LEAST letters stay or the whole
is hex. A core of fewer is never random. The encoding is inferred from the core's letters: hex (alphabet of
16), base32 (32), base36 in one case (36), else base62, which is base64 without signs. Its chi-squared
statistic against a uniform alphabet of that size serves twice: a run that is too uneven to be random (an
upper tail below UNIFORM_LEAST, by Wilson and Hilferty's cube root) is none; and it is the first of three
tests that ask how likely the run is as ordinary text, whose parameters are fixed:
  * uniformity: chi-squared is low for random letters, and for text as high as its index of coincidence
    (IC_TEXT) makes it;
  * runs: changes between lower case, upper case and digits, but not from a capital to a small letter;
    random letters change often;
  * serial correlation: of neighbouring letters' values; near 0 for random, SERIAL_TEXT for ordinary.
Fisher's method joins the three p-values. False discoveries are controlled in each text by a weighted
step-up rule: p / weight against FDR * rank / candidates, with a weight that grows with a run's length
(capped at 2, mean near 1), as longer runs carry more evidence.

Edge cases: a null text counts as empty: no spans, the hash of nothing. Ties between kinds at one start
go in the order assign, access, hex, random. Long texts are one row's arrays, no rows are made of them.
Equal texts have equal spans; ids are not used, so null and repeated ones are rows like any other. An empty
table gives an empty result. Other columns, whatever their names, are carried by redact() and left out by
scan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: What a match of ASSIGN has before its second group, and that group's least length.
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Kinds of spans, in the order of ties.
KINDS = ("assign", "access", "hex", "random")
HEX_ONLY = "^([0-9a-f]+|[0-9A-F]+)$"
#: At 0.05 keys of 20 to 32 letters were missed more often (base36 of 24: 0.79 found), at 0.15 nine of ten and more of
#: each kind tried are found and one in 1,500 joined words of ordinary text is; at 0.3 it is 1.7 %.
FDR = 0.15
IC_TEXT, CUBE_TEXT = 0.062, 0.0055
CHANGE_TEXT = 0.2
SERIAL_TEXT = 0.2
#: Least upper tail of chi-squared that still counts as random.
UNIFORM_LEAST = 0.0005
CORE_LEAST, RUN_LEAST = 16, 20


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with a name for a value, which is computed once."""
    return f"get(transform(array({value}), {name} -> ({body})), 0)"


def _scan(numbers: str, join: str) -> str:
    """SQL of the running joins (of x and the sum or maximum before it, y) of an array, in doubling rounds."""
    rounds = "sequence(0, cast(ceil(log2(greatest(1, size(sc)))) as int))"
    return _let("sc", numbers, f"aggregate({rounds}, sc, (acc, k) -> transform(acc, (x, i) -> if(i >= shiftleft(1, k), {join.format(x='x', y='get(acc, i - shiftleft(1, k))')}, x)))")


def _below(array: str, value: str) -> str:
    """SQL of how many structs of an array sorted by s have an s below the value, by halving."""
    half = "shiftright(bi.lo + bi.hi, 1)"
    step = f"if(bi.lo >= bi.hi, bi, if(get({array}, {half}).s < {value}, named_struct('lo', {half} + 1, 'hi', bi.hi), named_struct('lo', bi.lo, 'hi', {half})))"
    return f"aggregate(sequence(0, cast(ceil(log2(size({array}) + 1)) as int)), named_struct('lo', 0, 'hi', size({array})), (bi, _k) -> {step}).lo"


def _spans(text: str, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches, code points, end exclusive."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    cut = f"filter(zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (piece, m) -> named_struct('l', char_length(piece), 'n', char_length(m), 'm', m)), x -> x.m is not null)"
    ends = _scan("transform(cut, x -> x.l + x.n)", "{x} + {y}")
    return F.expr(_let("cut", cut, f"zip_with(cut, {ends}, (x, e) -> named_struct('s', e - x.n, 'e', e, 'm', x.m))"))


_NO_SPANS = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def _phi(z: str) -> str:
    """Standard normal distribution function, by a logistic form (error below 2e-4)."""
    return _let("z", z, "1 / (1 + exp(greatest(-600D, least(600D, -(1.5976D * z + 0.070566D * z * z * z)))))")


def _klass(c: str) -> str:
    return f"(case when {c} between 97 and 122 then 1 when {c} between 65 and 90 then 2 else 3 end)"


def _core(run: str) -> str:
    """SQL of the letters of a run that are tested."""
    joined = "regexp_replace(regexp_replace({m}, '{head}', ''), '[-_=/+]', '')"
    whole, bare = joined.format(m=run, head="^0[xX]"), joined.format(m=run, head="^([A-Za-z]{1,10}[-_])*(0[xX])?")
    return _let("whole", whole, _let("bare", bare, f"if(whole rlike '{HEX_ONLY}' or char_length(bare) < {CORE_LEAST}, whole, bare)"))


def _battery(run: str) -> str:
    """SQL of the joint p-value of a run (a struct with field m), or 1 where it cannot be random."""
    alphabet = f"case when m rlike '{HEX_ONLY}' then 16 when m rlike '^[A-Z2-7]+$' then 32 when m rlike '^([0-9a-z]+|[0-9A-Z]+)$' then 36 else 62 end"
    squares = "aggregate(array_distinct(split(m, '')), 0D, (a, x) -> a + pow(cast(n - char_length(replace(m, x, '')) as double), 2))"
    chi = f"k * {squares} / n - n"
    changes = f"aggregate(sequence(1, n - 1), 0D, (a, i) -> a + if({_klass('c[i]')} <> {_klass('c[i - 1]')} and not (c[i] between 97 and 122 and c[i - 1] between 65 and 90), 1, 0)) / (n - 1)"
    serial = "aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (c[i] - mu) * (c[i - 1] - mu)) / greatest(1D, aggregate(c, 0D, (a, x) -> a + (x - mu) * (x - mu)))"
    # Letters that agree by chance IC_TEXT of the time make chi-squared as high as this.
    usual = f"(k * ({IC_TEXT}D * if(k = 16, 1.8D, 1D) * (n - 1D) + 1D) - n)"
    spread = f"k * (n - 1D) * sqrt(2D / (n * (n - 1D)) * ({IC_TEXT - IC_TEXT**2:.8f}D + 2 * (n - 2) * {CUBE_TEXT - IC_TEXT**2:.8f}D))"
    joint = " * ".join(
        [
            _phi(f"(chi - {usual}) / ({spread})"),
            _phi(f"({CHANGE_TEXT}D - {changes}) / sqrt({CHANGE_TEXT * (1 - CHANGE_TEXT):.8f}D / (n - 1))"),
            _phi(f"(abs({_let('mu', 'aggregate(c, 0D, (a, x) -> a + x) / n', serial)}) - {SERIAL_TEXT}D) * sqrt(cast(n as double))"),
        ]
    )
    # Fisher: the product q of three p-values has the tail q * (1 - ln q + (ln q)^2 / 2).
    p = _let("q", f"greatest(1e-300D, {joint})", "q * (1 - ln(q) + ln(q) * ln(q) / 2)")
    tail = _phi("(1D - 2D / (9D * (k - 1)) - pow(chi / (k - 1), 1D / 3)) / sqrt(2D / (9D * (k - 1)))")
    inner = f"if(n < {CORE_LEAST}, 1D, " + _let("chi", chi, f"if({tail} < {UNIFORM_LEAST}D, 1D, {p})") + ")"
    return _let("m", _core(f"{run}.m"), _let("n", "char_length(m)", _let("k", alphabet, _let("c", "transform(split(m, ''), x -> ascii(x))", inner))))


def with_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds assign, access, hex and random: arrays of struct<s, e, m>."""
    t = f"coalesce({text}, '')"
    found = rows
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE)):
        # A cheap test first: most texts have no match.
        found = found.withColumn(name, F.when(F.expr(t).rlike(pattern), _spans(t, pattern)).otherwise(F.expr(_NO_SPANS)))
    head = ASSIGN_HEAD.replace("\\", "\\\\").replace("'", "\\'")
    found = found.withColumn("assign", F.expr(f"filter(assign, x -> char_length(regexp_replace(x.m, '{head}', '')) >= {ASSIGN_LEAST})"))
    bare = "concat(" + ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e))" for k in KINDS[:3]) + ")"
    # What the spans that start inside a run leave of it, from the end of those that start before it.
    # A gap lies between the end of all spans before and the next start; the last ends with the run.
    gap = "named_struct('s', greatest(c.s, coalesce(get(reach, j - 1), 0)), 'e', if(j < hi, get(base, j).s, c.e))"
    gaps = _let("lo", _below("base", "c.s"), _let("hi", _below("base", "c.e"), f"transform(sequence(lo, hi), j -> {gap})"))
    # Runs are ASCII, so places are bytes, which are cut without a search from the start.
    part = "cast(substring(bytes, g.s - c.s + 1, g.e - g.s) as string)"
    left = _let("bytes", "cast(c.m as binary)", f"transform(filter({gaps}, g -> g.e - g.s >= {RUN_LEAST}), g -> named_struct('s', g.s, 'e', g.e, 'm', {part}))")
    reach = _scan("transform(base, x -> x.e)", "greatest({x}, {y})")
    cut = _let("base", f"sort_array({bare})", f"if(size(base) = 0, random, {_let('reach', reach, f'flatten(transform(random, c -> {left}))')})")
    found = found.withColumn("random", F.expr(cut))
    tested = found.withColumn("tested", F.expr(f"transform(random, x -> named_struct('p', {_battery('x')}, 'n', char_length(x.m), 's', x.s, 'e', x.e, 'm', x.m))"))
    mean = "(aggregate(tested, 0D, (a, x) -> a + least(2D, x.n / 32D)) / size(tested))"
    weigh = "array_sort(transform(tested, x -> named_struct('q', x.p * mean / least(2D, x.n / 32D), 's', x.s, 'e', x.e, 'm', x.m)))"
    weighed = tested.withColumn("tested", F.expr(f"if(size(tested) = 0, cast(array() as array<struct<q:double,s:int,e:int,m:string>>), {_let('mean', mean, weigh)})"))
    # Step-up: the last rank whose weighted p-value is below its line, and all before it.
    ranked = weighed.withColumn("ranks", F.expr(f"aggregate(sequence(0, size(tested)), 0, (a, i) -> if(i < size(tested) and get(tested, i).q <= {FDR}D * (i + 1) / size(tested), i + 1, a))"))
    return ranked.withColumn("random", F.expr("transform(slice(tested, 1, ranks), x -> named_struct('s', x.s, 'e', x.e, 'm', x.m))")).drop("tested", "ranks")


def _listed(kinds: tuple[str, ...]) -> str:
    """SQL of 'kind:start:end', comma-joined by start, then kind as listed."""
    each = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(kinds))
    name = "case x.k " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(kinds)) + " end"
    return f"array_join(transform(sort_array(concat({each})), x -> concat({name}, ':', x.s, ':', x.e)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    rows = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    listed = rows.select("id", *KINDS, F.expr(_listed(KINDS[:3])).alias("base"), F.expr(_listed(KINDS)).alias("spans"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return fenced(listed.select(F.col("id").alias(id_col), *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"))


MASK = "[SECRET]"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with every span of the text replaced by MASK; a null text stays."""
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(rows)
    merged = found.withColumn("all", F.expr("sort_array(concat(" + ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e))" for k in KINDS) + "))"))
    # A span that starts behind the end of all before it opens a mask; what lies between is cut from four bytes a
    # code point, so that no cut searches the text from its start.
    piece = "decode(substring(points, 4 * coalesce(get(reach, j - 1), 0) + 1, 4 * (get(all, j).s - coalesce(get(reach, j - 1), 0))), 'UTF-32')"
    opened = "filter(sequence(0, size(all) - 1), j -> get(all, j).s >= coalesce(get(reach, j - 1), 0))"
    rest = "decode(substring(points, 4 * element_at(reach, -1) + 1, octet_length(points)), 'UTF-32')"
    joined = _let("points", "encode(text, 'UTF-32')", f"array_join(concat(transform({opened}, j -> concat({piece}, '{MASK}')), array({rest})), '')")
    masked = F.expr(f"if(size(all) = 0, text, {_let('reach', _scan('transform(all, x -> x.e)', 'greatest({x}, {y})'), joined)})")
    out = merged.select("row", masked.alias("masked"))
    return fenced(out.select(*(F.col("masked").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns)))
