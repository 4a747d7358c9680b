"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

Lexicon: whole words and word stems whose rate in toxic training texts is a multiple of that in clean
ones. The trie of the lexicon and the Levenshtein automata of its terms run as one deterministic
automaton over a word's letters, built lazily: a state is a set of (trie node, edits so far), so a
word is looked up in as many steps as it has letters, whatever the lexicon's size. Whole words may be
misspelled (one edit from FUZZY_1 letters on, two from FUZZY_2), stems must open a word as they are.
A misspelling that clean training texts use as a word of its own does not count.

Context: the words around a hit tell quotation from abuse. Quote marks that open before it and close
after it, and words of saying, lower its weight; words of address raise it. The text's features (sum
of weights against length, strongest hits, their number) go through a logistic model.

Training: labels of rows whose crc32(id as text) mod 4 is not 2; at most PER_CLASS texts of a class,
those with the smallest seeded hash of the id. Where
that changes the share of toxic texts, the model's constant is set back to the share among all labels.
Terms are counted, weighed and turned into features where the texts are; the driver gets the lexicon, which is bounded by the sample, and a row of features a text,
never a text. Every text of the corpus is scored.

Edge cases: a null or wordless text has no hit and gets the model's base score; equal texts get equal
scores; an empty label table, or one without both labels, gives an empty lexicon and score 0 everywhere;
an empty documents table gives an empty result. Repeated ids are rows of their own when scored; in
training an id counts once, with its greatest label and, of several texts, the one with the least hash.
A term found at several distances counts by the fewest edits, of equals by the smaller term. A very long
text is one row's work, linear in its words. Columns of other names, also those used here, are carried or
left out and never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, compact, durable, worker_state

THRESHOLD = 0.3
#: Training texts of a class at most, a documented bound; they are used whole.
PER_CLASS = 2500
#: Training texts that a term must stand in, and its least rate against clean texts.
SUPPORT, RATIO = 5, 6.0
#: Letters of a stem.
STEMS = (6, 7, 8)
FUZZY_1, FUZZY_2 = 5, 9
WINDOW = 6
#: Lazily built states that are kept, some 1 KB each.
STATES = 100_000
#: Words of saying and of address around a hit.
SAYING = frozenset("said says say wrote writes called calls quote quoted quoting quotes word words term insult dit disait écrit appelle citation sagte sagt schrieb nannte zitat dijo dice escribió llamó cita".split())
ADDRESS = frozenset("you your youre u yourself tu toi ton ta vous du dein deine dich ihr eres usted tú".split())
_WORD = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\"“«‘„'", "\"”»’“'"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lexicon:
    """Trie x Levenshtein automata as one lazy automaton. terms: {term: weight}; stems: the same for
    word openings; clean: words that are no misspellings."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: frozenset[str] = frozenset()):
        self.terms, self.stems, self.clean = terms, stems, clean
        self.child: list[dict[str, int]] = [{}]
        self.reach: list[int] = [0]  # most edits that a term below a node allows
        self.whole: dict[int, str] = {}
        self.opens: dict[int, str] = {}
        for group, ends in ((terms, self.whole), (stems, self.opens)):
            for t in sorted(group):
                edits, node = self.edits(t) if group is terms else 0, 0
                for c in t:
                    self.reach[node] = max(self.reach[node], edits)
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.reach.append(0)
                    node = self.child[node][c]
                self.reach[node] = max(self.reach[node], edits)
                ends[node] = t
        self.sets: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.table: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stem: list[str | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})
        self.cache = Cache()

    @staticmethod
    def edits(term: str) -> int:
        return (len(term) >= FUZZY_1) + (len(term) >= FUZZY_2)

    def _state(self, nodes: dict[int, int]) -> int:
        """A subset state from {trie node: fewest edits}, closed under letters left out."""
        todo = list(nodes.items())
        best: dict[int, int] = {}
        while todo:
            n, e = todo.pop()
            if e > self.reach[n] or best.get(n, 9) <= e:
                continue
            best[n] = e
            todo += [(m, e + 1) for m in self.child[n].values()]
        key = frozenset(best.items())
        if key not in self.sets:
            self.sets[key] = len(self.members)
            self.members.append(best)
            self.table.append({})
            found = [(e, self.whole[n]) for n, e in best.items() if n in self.whole and e <= self.edits(self.whole[n])]
            self.ends.append(min(found)[::-1] if found else None)
            exact = [self.opens[n] for n, e in best.items() if n in self.opens and e == 0]
            self.stem.append(exact[0] if exact else None)
        return self.sets[key]

    def _next(self, at: int, c: str) -> int:
        new: dict[int, int] = {}
        for n, e in self.members[at].items():
            steps = [(n, e + 1)]  # a letter too many
            steps += [(m, e + (d != c)) for d, m in self.child[n].items()]
            for m, k in steps:
                if k <= self.reach[m] and k < new.get(m, 9):
                    new[m] = k
        to = self.table[at][c] = self._state(new)
        return to

    def search(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, is a stem): the best whole-word match, else the longest stem."""
        if len(self.members) > STATES:  # lazily built states are only a cache, words already looked up stay
            cache = self.cache
            self.__init__(self.terms, self.stems, self.clean)
            self.cache = cache
        at, stem = self.start, None
        for c in word:
            to = self.table[at].get(c)
            at = self._next(at, c) if to is None else to
            if at == self.dead:
                break
            if self.stem[at]:
                stem = self.stem[at]
        end = self.ends[at]
        if end and (end[1] == 0 or word not in self.clean):
            return (*end, False)
        return (stem, 0, True) if stem else None

    def weight(self, word: str) -> float:
        known = self.cache.map.get(word)
        if known is None:
            found = self.search(word)
            known = 0.0 if found is None else (self.stems if found[2] else self.terms)[found[0]] * (1.0, 0.8, 0.6)[found[1]]
            self.cache.room()
            self.cache.add(word, known, 130 + 2 * len(word))
        return known


def context(text: str, spans: list[tuple[int, int]], k: int) -> float:
    """Factor of the k-th word (1 without a sign either way) from the words around it."""
    lo, hi = max(0, k - WINDOW), min(len(spans), k + WINDOW + 1)
    near = [text[a:b].lower() for a, b in spans[lo:hi]]
    before, after = text[spans[lo][0] : spans[k][0]], text[spans[k][1] : spans[hi - 1][1] + 2]
    quoted = 0 < sum(before.count(c) for c in set(_OPEN)) and 0 < sum(after.count(c) for c in set(_CLOSE))
    factor = 1.0
    if quoted:
        factor *= 0.4
    if any(w in SAYING for w in near):
        factor *= 0.6
    if any(w in ADDRESS for w in near):
        factor *= 1.3
    return factor


def features(text: str, lexicon: Lexicon, rate: float = 0.0) -> list[float]:
    """Of one whole text, each different word by its strongest place: 1, density of weights among the
    different words, log of their sum over what clean texts of this length would have (rate a word), the
    strongest hit, log of the different hits and of all. Without hits: 1 and zeros."""
    words = words_of(text)
    weight, get = lexicon.weight, lexicon.cache.map.get
    hits = []
    for k, w in enumerate(words):
        x = get(w)
        if x is None:
            x = weight(w)
        if x:
            hits.append(k)
    if not hits:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    lower = text.lower()
    spans = [m.span() for m in _WORD.finditer(lower)]
    best: dict[str, float] = {}
    for k in hits:
        w = words[k]
        best[w] = max(best.get(w, 0.0), lexicon.weight(w) * context(lower, spans, k))
    total = sum(best.values())
    return [1.0, min(1.0, 10 * total / (len(set(words)) + 20)), math.log((total + 0.5) / (rate * len(words) + 1)), max(best.values()), math.log1p(len(best)), math.log1p(len(hits))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; the constant is not penalised."""
    w, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + pen, x.T @ (y - p) - pen @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()
    weights: tuple[float, ...] = ()
    rate: float = 0.0

    def key(self) -> int:
        return hash((tuple(self.terms.items()), tuple(self.stems.items()), self.clean, self.weights))

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.stems, self.clean)

    def score(self, text: str, lexicon: Lexicon) -> float:
        if not self.weights:
            return 0.0
        z = sum(a * b for a, b in zip(self.weights, features(text, lexicon, self.rate), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def grams(text: str) -> Counter:
    """Times of each term of a text: =word for a whole word, its opening letters for a stem."""
    out: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        out["=" + w] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k]] += n
    return out


def rate_of(toxic_times: int, clean_times: int, total: tuple[int, int]) -> float:
    """Log ratio of a term's share of the words of toxic texts to that of clean ones (total: clean, toxic)."""
    return math.log(((toxic_times + 0.5) / total[1]) / ((clean_times + 0.5) / total[0]))


def lexicon_of(counts: list[tuple[str, int, int, int, int]], n_texts: tuple[int, int], total: tuple[int, int]) -> tuple[dict, dict]:
    """Terms and stems with weights from (term, texts clean, texts toxic, times clean, times toxic) rows."""
    top, terms, stems = math.log(1000), {}, {}
    for t, used0, used1, times0, times1 in sorted(counts):
        rate = rate_of(times1, times0, total)
        if used1 >= SUPPORT and rate > math.log(RATIO) and used1 / n_texts[1] > 2 * used0 / n_texts[0]:
            (terms if t[0] == "=" else stems)[t.removeprefix("=")] = min(1.0, rate / top)
    return terms, stems


def misread(word: str, lexicon: Lexicon) -> bool:
    """A word that an edit would take for a term."""
    found = lexicon.search(word)
    return bool(found and found[1])


def clean_weight(text: str, lexicon: Lexicon) -> tuple[float, int]:
    """Sum of weights and number of words."""
    words = words_of(text)
    return sum(map(lexicon.weight, words)), len(words)


def fit(texts: list[tuple[str, int]]) -> Model:
    """Lexicon and model from (text, label) rows in memory, by the steps that train() distributes."""
    used: dict[int, Counter] = {0: Counter(), 1: Counter()}
    times: dict[int, Counter] = {0: Counter(), 1: Counter()}
    total, n_texts = [1, 1], Counter(y for _, y in texts)
    if not n_texts[0] or not n_texts[1]:
        return Model()
    for text, y in texts:
        g = grams(text)
        total[y] += sum(n for t, n in g.items() if t[0] == "=")
        times[y].update(g)
        used[y].update(g.keys())
    counts = [(t, used[0][t], n, times[0][t], times[1][t]) for t, n in used[1].items()]
    terms, stems = lexicon_of(counts, (n_texts[0], n_texts[1]), tuple(total))
    open_ = Lexicon(terms, stems)
    model = Model(terms, stems, frozenset(t[1:] for t, n in used[0].items() if t[0] == "=" and n >= 2 and misread(t[1:], open_)))
    lexicon = model.lexicon()
    held = [h for h in (clean_weight(t, lexicon) for t, y in texts if not y) if h[0]]
    model.rate = sum(h[0] for h in held) / max(1, sum(h[1] for h in held))
    x = np.array([features(t, lexicon, model.rate) for t, _ in texts])
    model.weights = tuple(_logistic(x, np.array([y for _, y in texts], float)).tolist())
    return model


def held_out(id_col: str) -> F.Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == 2


def _texts(rows: DataFrame, schema: pa.Schema, ddl: str, each) -> DataFrame:
    """A frame of what each(text, y) yields for every row (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                out = list(zip(*each(text.as_py() or "", y), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out or [()] * len(schema), schema, strict=True)], schema=schema)

    return rows.select("text", "y").mapInArrow(run, ddl)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 5) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = [F.xxhash64("id", F.lit(seed)), "id"]
    ids = usable.where("y = 1").orderBy(*order).limit(PER_CLASS).unionAll(usable.where("y = 0").orderBy(*order).limit(PER_CLASS))
    # At most 2 * PER_CLASS rows: broadcast. An id has one text, whatever its rows.
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = durable(met.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), 2 * PER_CLASS)
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model()
    every = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    kind = pa.schema([("term", pa.string()), ("y", pa.int32()), ("times", pa.int64())])
    counted = _texts(rows, kind, "term string, y int, times long", lambda t, y: [(g, y, k) for g, k in grams(t).items()])
    sums = [F.sum(F.when(F.col("y") == y, v).otherwise(0)).cast("long").alias(c) for c, y, v in (("used0", 0, F.lit(1)), ("used1", 1, F.lit(1)), ("times0", 0, F.col("times")), ("times1", 1, F.col("times")))]
    terms = durable(counted.groupBy("term").agg(*sums), 2 * PER_CLASS * 1000)  # the bound only sizes files
    words = terms.where("startswith(term, '=')")
    total = tuple(1 + (x or 0) for x in words.agg(F.sum("times0"), F.sum("times1")).first())
    counts = [tuple(r) for r in terms.where((F.col("used1") >= SUPPORT) & (F.col("used1") * n[0] > 2 * F.col("used0") * n[1]) & (F.col("times1") > 0)).collect()]
    model = Model(*lexicon_of(counts, (n[0], n[1]), total))
    near = _clean_words(words.where("used0 >= 2"), model)
    model.clean = frozenset(r.word for r in near.collect())

    def each(text: str, y: int) -> list[tuple]:
        return [(y, *clean_weight(text, _lexicon(model)))]

    held = _texts(rows.where("y = 0"), pa.schema([("y", pa.int32()), ("weight", pa.float64()), ("n", pa.int64())]), "y int, weight double, n long", each).where("weight > 0").collect()
    model.rate = math.fsum(h.weight for h in held) / max(1, sum(h.n for h in held))
    k = len(features("", model.lexicon()))
    kind = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    found = _texts(rows, kind, "y int, x array<double>", lambda t, y: [(y, features(t, _lexicon(model), model.rate))]).collect()
    found.sort(key=lambda r: (r.y, r.x))
    weights = _logistic(np.array([r.x for r in found]).reshape(-1, k), np.array([r.y for r in found], float))
    # The sample may hold another share of toxic texts than all labels do; the constant takes that back.
    weights[0] += math.log(every[1] / every[0]) - math.log(min(every[1], PER_CLASS) / min(every[0], PER_CLASS))
    model.weights = tuple(weights.tolist())
    return model


def _clean_words(words: DataFrame, model: Model) -> DataFrame:
    """Of terms =word, the words that an edit would take for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w[1:] for w in batch.column(0).to_pylist() if misread(w[1:], lexicon)], pa.string())], names=["word"])

    return words.select("term").mapInArrow(run, "word string")


def _lexicon(model: Model) -> Lexicon:
    """The model's automaton and cache in this worker."""
    return worker_state(("toxicity", model.key()), model.lexicon)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score: one row per input row."""
    return docs.select(id_col, _scorer(model)(F.col(text_col)).alias("score"))


def _scorer(model: Model):
    """The score of a text column, in Arrow batches of that column alone."""

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = _lexicon(model)
        for batch in texts:
            yield pa.array([model.score(t.as_py() or "", lexicon) for t in batch], pa.float64())

    return scored


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those that score THRESHOLD or more."""
    return compact(docs.where(_scorer(model)(F.col(text_col)) < THRESHOLD), docs)
