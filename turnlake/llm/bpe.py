"""Byte-level BPE by merge replay over a corpus block, and decoding.

Texts are cut into matches of the tokenizer's pattern. The distinct new matches of a block of texts
form the replay's corpus. Words of up to SHORT bytes replay in rounds over one flat array: in a round every
word applies its merge of least rank, the leftmost of equals, all words at once; ranks of the pairs left and
right of the places are looked up in one sorted table. For longer words an inverted index maps every
adjacent token pair to the word positions where it stands, and the merges that occur are applied in rank
order, each at all its places at once. A merge touches only the pairs left and right of a place, which
leave and enter the index. Since a byte-level merge order is by rank inside each word, both equal encoding
word by word.

In the index words are linked lists, so a word of any length costs n log n. What a word turns
into (ids, their decimal form, its decoded bytes) stays in a cache of bounded bytes; a text's result is
the concatenation over its words. No shuffle; memory is bounded by the block and the cache.

Edge cases: a null text counts as empty (no ids, hashes of nothing); unpaired surrogates cannot
occur in Spark strings; special-token strings are ordinary text. Repeated rows and ids are rows of their
own with equal results; an empty table gives an empty result; a very long text is a block of its own.
Ties between places of one merge go to the leftmost (a a a). Other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, compact, worker_state

#: Characters of text that are split together, though one text whole at least, and of new words that one
#: replay takes: its lists take some 200 bytes a character.
BLOCK, REPLAY = 300_000, 150_000
#: The rank of pairs that no merge joins.
NONE = 1 << 40
_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Bytes of a word that replays in rounds; their number is that of its merges.
SHORT = 64
#: Entries of the table of merges at most; it is only a cache.
MERGES = 150_000


class Coder:
    """Encoder and decoder of a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        #: Rank of each pair of bytes, or NONE.
        self.bytes_rank = np.array([self.rank.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int64)
        #: Pair (left << 20 | right) -> rank of the merged token, or NONE.
        self.merge: dict[int, int] = {}
        self.cache = Cache(40 << 20, 16 << 20)
        self.decimal = {r: str(r) for r in self.token}
        # All pairs of tokens that a merge joins, in order, and the ranks they turn into.
        ranks = self.rank
        joined = sorted((ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs, self.joins = np.array([p for p, _ in joined] + [NONE << 20], np.int64), np.array([r for _, r in joined] + [NONE], np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of merged pairs, or NONE."""
        pair = left << 20 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.joins[at], NONE)

    def rounds(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, none of them empty: every round merges one place in each word."""
        out: list[list[int]] = [[]] * len(words)
        if not words:
            return out
        line = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths, live = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
        ends = np.cumsum(lengths)
        ids, ranks = self.single[line], np.append(self.bytes_rank[line[:-1] << 8 | line[1:]], NONE)
        ranks[ends - 1] = NONE
        while True:
            least = np.minimum.reduceat(ranks, ends - lengths)
            over = least == NONE
            if over.any():
                flags = np.repeat(over, lengths)
                flat, cuts = ids[flags].tolist(), np.cumsum(lengths[over]).tolist()
                for w, a, b in zip(live[over].tolist(), [0, *cuts], cuts, strict=False):
                    out[w] = flat[a:b]
                ids, ranks, lengths, live, least = ids[~flags], ranks[~flags], lengths[~over], live[~over], least[~over]
                if not len(live):
                    return out
            word = np.repeat(np.arange(len(live)), lengths)
            hits = np.flatnonzero(ranks == least[word])
            of = word[hits]
            places = hits[np.append(True, of[1:] != of[:-1])]  # the leftmost in each word
            ids[places] = least
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            ids, ranks, lengths = ids[keep], ranks[keep], lengths - 1
            ends, places = np.cumsum(lengths), places - np.arange(len(places))
            ranks[places] = NONE
            before, after = places[places > ends - lengths] - 1, places[places < ends - 1]
            touched = np.concatenate([before, after])
            ranks[touched] = self._join(ids[touched], ids[touched + 1])

    def _merged(self, pair: int) -> int:
        if len(self.merge) > MERGES:
            self.merge.clear()
        r = self.merge[pair] = self.rank.get(self.token[pair >> 20] + self.token[pair & 0xFFFFF], NONE)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        line = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = ends - np.fromiter(map(len, words), np.int64, len(words))
        places = np.arange(len(line))
        after, before = places + 1, places - 1
        after[ends - 1], before[starts] = -1, -1
        # The index: rank of a merged token -> places of the left halves, in order.
        ranks = np.append(self.bytes_rank[line[:-1].astype(np.int64) << 8 | line[1:]], NONE)
        ranks[ends - 1] = NONE
        found = np.flatnonzero(ranks != NONE)
        order = found[np.argsort(ranks[found], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        groups = np.split(order, cuts[1:])
        index = {int(ranks[g[0]]): g.tolist() for g in groups if len(g)}
        heap = sorted(index)
        ids, right, left = self.single[line].tolist(), after.tolist(), before.tolist()
        merge, merged, push, pop = self.merge, self._merged, heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            places = index.pop(r)
            places.sort()  # equal neighbours (a a a) overlap: the leftmost goes first
            for k, p in enumerate(places):
                if heap and heap[0] < r:  # a merge has made an earlier one possible: it goes first
                    index[r] = places[k:] + index.get(r, [])
                    push(heap, r)
                    break
                q = right[p]
                a = ids[p]
                if q < 0 or a < 0:
                    continue
                pair = a << 20 | ids[q]
                x = merge.get(pair)
                if x is None:
                    x = merged(pair)
                if x != r:
                    continue  # another merge has since changed this place
                ids[p], ids[q] = r, -1
                n = right[p] = right[q]
                if n >= 0:
                    left[n] = p
                    pair = r << 20 | ids[n]
                    x = merge.get(pair)
                    if x is None:
                        x = merged(pair)
                    if x != NONE:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            push(heap, x)
                b = left[p]
                if b >= 0:
                    pair = ids[b] << 20 | r
                    x = merge.get(pair)
                    if x is None:
                        x = merged(pair)
                    if x != NONE:
                        if x in index:
                            index[x].append(b)
                        else:
                            index[x] = [b]
                            push(heap, x)
        out = []
        for at in starts.tolist():
            one, p = [], at
            while p >= 0:
                one.append(ids[p])
                p = right[p]
            out.append(one)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def learn(self, words: list[str]) -> None:
        """Replay the merges over new words and keep what they turn into."""
        at = 0
        while at < len(words):
            end, room = at, REPLAY
            while end < len(words) and (room > 0 or end == at):
                room -= len(words[end])
                end += 1
            block = words[at:end]
            coded = [w.encode("utf-8", "surrogatepass") for w in block]
            short, long = self.rounds([c for c in coded if len(c) <= SHORT]), [c for c in coded if len(c) > SHORT]
            found = iter(short), iter(self.replay(long) if long else [])
            for w, c in zip(block, coded, strict=True):
                ids = next(found[len(c) > SHORT])
                line, decoded = ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids)
                self.cache.add(w, (len(ids), line, decoded), 330 + 2 * len(w) + len(line) + len(decoded))
            at = end

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, str, bytes]]:
        """Count, decimal form and decoded bytes of the ids of each text. One replay takes the new
        words of texts of about BLOCK characters together."""
        split, room = [], BLOCK
        for k, t in enumerate(texts):
            text = t.as_py() or ""
            room -= len(text)
            split.append(_SPLIT.findall(text))
            if room > 0 and k + 1 < len(texts):
                continue
            distinct = set(chain.from_iterable(split))
            if distinct.difference(self.cache.map):
                self.cache.room()
                self.learn(sorted(distinct.difference(self.cache.map)))
            known = self.cache.map.__getitem__
            for words in split:
                parts = list(map(known, words))
                yield sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])
            split, room = [], BLOCK

    def encode(self, text: str) -> list[int]:
        line = next(self.texts(pa.array([text])))[1]
        return [int(x) for x in line.split(",")] if line else []


def coder(path: str) -> Coder:
    return worker_state(("bpe", path), lambda: Coder(path))


def encode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per input row: id_col, n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for n, line, decoded in c.texts(batch.column(1)):
                row = (n, [int(i) for i in line.split(",")] if ids and line else [], hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            arrays = [pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    out = compact(out.withColumnRenamed("id", id_col), docs)
    return out if ids else out.drop("ids")


def decode(encoded: DataFrame, ranks: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Add decoded (binary) for a column of id arrays; a null array stays null."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf("binary")
    def back(ids):
        c = coder(path)
        return ids.map(lambda x: None if x is None else c.decode(list(map(int, x))))

    return encoded.withColumn("decoded", back(F.col(ids_col)))
