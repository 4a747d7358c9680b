"""Token-ID files: flat little-endian unsigned integers plus 64-bit document offsets.

A data set is a folder of shards in ascending id order. shard-NNNNN.ids is a flat array of unsigned
integers (2 bytes each if the vocabulary fits, else 4); shard-NNNNN.idx holds three int64 parts: a
head (documents, bytes per id), the document ids, and documents + 1 offsets in ids. Readers map both
into memory. Shards come from a range partition on the document id, then the text's hash; a shard's base (the ids
of all shards before it) is the prefix sum of shard sizes, one number a shard.

Texts are cut before a space that follows a non-space character: the tokenizer's own pattern always
starts a new word there. A piece is cut into the pattern's words, whose ids the tokenizers library's
model gives; words of Latin letters, alone or before a mark, need no pattern; both stay in caches of bounded bytes and concatenate to those of the text. (Giving the
library whole pieces instead cost half as much again.)

Folders are paths, file: URIs or URIs of any store that Arrow's file systems open; only local files are
mapped into memory, others are read a shard at a time.

Edge cases: a null text counts as empty and yields the end id alone; equal or null document ids stay
apart, in the order (id nulls first, hash of the text); an empty table makes no shard and an empty
result; a very long text is one row's work, written as soon as it is encoded. Other columns, whatever
their names, are left out. Files appear by a rename, so a repeated task leaves the same bytes.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, durable, remove, shared_dir, worker_state

END_ID = 0
_CUT = re.compile(r"(?<=\S) ")
_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, the
#: rest take the code points from 256 on in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE = chr(_BYTE_LETTERS[0x20])


#: A word of Latin letters, and one of the marks that may end it.
_MARKS = ".,;:!?"
_PLAIN = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[{_MARKS}]?").fullmatch


class _Space(Exception):
    """A piece that is empty or ends in white space."""


class _Pieces(dict):
    """Ids of pieces; one that is not there is made."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece)


class Encoder:
    """Ids of whole texts as bytes of a fixed-width unsigned type."""

    def __init__(self, path: str, kind: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype(kind or ("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"))
        most = max(self.tokenizer.get_vocab().values(), default=0)
        #: Bytes of each id.
        self.packed = [k.to_bytes(self.kind.itemsize, "little") for k in range(most + 1)]
        self.pieces, self.words = Cache(64 << 20, 32 << 20), Cache(8 << 20, 4 << 20)
        self.pieces.map = _Pieces(self._piece)

    def _word(self, word: str) -> bytes:
        """Ids of one match of the tokenizer's pattern."""
        ids = self.words.map.get(word)
        if ids is None:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_LETTERS)
            ids = self._ids(letters)
            self.words.room()
            self.words.add(word, ids, 140 + 2 * len(word) + len(ids))
        return ids

    def _ids(self, letters: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(letters)])

    def _split(self, piece: str) -> bytes:
        return b"".join(map(self._word, _PATTERN.findall(piece)))

    def _piece(self, p: str) -> bytes:
        """Ids of a new piece behind its space: a word of Latin letters, alone or before a mark, needs no pattern."""
        if not p or p[-1].isspace():
            raise _Space
        found = _PLAIN(p)
        if not found:
            ids = self._split(" " + p)
        elif p[-1] in _MARKS:
            ids = self.pieces.map[p[:-1]] + self._word(p[-1])
        elif p.isascii():
            ids = self._ids(_SPACE + p)
        else:
            ids = self._ids((" " + p).encode().decode("latin-1").translate(_BYTE_LETTERS))
        self.pieces.add(p, ids, 140 + 2 * len(p) + len(ids))
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        self.pieces.room()
        first, *pieces = text.split(" ")
        known, end = self.pieces.map.__getitem__, b""
        try:
            if first[-1:].isspace():
                raise _Space
            body = b"".join(map(known, pieces))
        except _Space:
            # Pieces that end in white space are never kept, so a text with a space after white space, where no
            # word need begin, shows here.
            first, *pieces = _CUT.split(text)
            if pieces:
                end = self._split(" " + pieces.pop())
            body = b"".join(map(known, pieces))
        return self._split(first) + body + end


def encoder(path: str) -> Encoder:
    return worker_state(("tokens", path), lambda: Encoder(path))


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in uri:
        uri = "file://" + ("/" + uri[5:].lstrip("/") if uri.startswith("file:") else os.path.abspath(uri))
    return pyarrow.fs.FileSystem.from_uri(uri)


def _place(store: pyarrow.fs.FileSystem, path: str, write) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, path)


#: Bytes of stored input of a shard, about, and most shards.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 1 << 20


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the data set into a new folder; (shard, path, n_docs, n_ids, base, width), one row a shard. Shards are of
    shard_bytes of stored input, about, or as many as there are shuffle partitions if that is more."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The hash makes ranges of one id, so many null or equal ids are several shards.
    by = [F.col("id").asc_nulls_first(), F.col("hash")]
    least = -(-int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // shard_bytes)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(min(least, MOST_SHARDS), *by) if least > usual else rows.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions(*by).select("id", "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        enc = encoder(tokenizer)
        name = f"{folder}/shard-{number:05d}"
        end = np.array([end_id], enc.kind).tobytes()
        # Eight bytes a number, whatever the shard holds.
        ids, nulls, sizes = array("q"), array("q"), array("q")

        def body(f) -> None:
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tokens = enc.encode(t.as_py())
                    f.write(tokens)
                    f.write(end)
                    if i is None:
                        nulls.append(len(ids))
                    ids.append(i or 0)
                    sizes.append(len(tokens) // enc.kind.itemsize + 1)

        _place(store, f"{name}.ids", body)
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, "<i8"))]).astype("<i8")
        null = np.array(nulls, "<i8")
        head = np.array([len(ids), enc.kind.itemsize, len(null)], "<i8")
        known = np.array(ids, "<i8")
        _place(store, f"{name}.idx", lambda f: f.write(b"".join(x.tobytes() for x in (head, null, known, offsets))))
        yield pa.RecordBatch.from_pydict({"shard": [number], "path": [f"{path}/shard-{number:05d}"], "n_docs": [len(ids)], "n_ids": [int(offsets[-1])], "width": [enc.kind.itemsize]})

    made = sorted(ordered.mapInArrow(shard, "shard long, path string, n_docs long, n_ids long, width long").collect())
    bases = np.concatenate([[0], np.cumsum([x.n_ids for x in made])]).tolist()
    table = [(*x, int(b)) for x, b in zip(made, bases, strict=False) if x.n_docs]
    return spark.createDataFrame(table, "shard long, path string, n_docs long, n_ids long, width long, base long")


def _mapped(uri: str, kind: str) -> np.ndarray:
    """A flat file of numbers: mapped into memory if it is local, else read."""
    store, path = _store(uri)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_shard(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, positions whose id is null, offsets and ids of a shard."""
    index = _mapped(f"{path}.idx", "<i8")
    n, width, n_null = (int(x) for x in index[:3])
    at = 3 + n_null
    return index[at : at + n], index[3:at], index[at + n : at + 2 * n + 1], _mapped(f"{path}.ids", f"<u{width}")


def read(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32, shard."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, null, offsets, ids = read_shard(row["path"])
                nulls = set(null.tolist())
                for lo in range(0, len(keys), 5000):
                    out = []
                    for k in range(lo, min(lo + 5000, len(keys))):
                        a, b = int(offsets[k]), int(offsets[k + 1])
                        out.append((None if k in nulls else int(keys[k]), row["base"] + a, b - a, zlib.crc32(ids[a:b].astype("<u4")), row["shard"]))
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5, strict=True)], names=["id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, shards.count())
    dealt = shards.repartition(n)
    return dealt.mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long, shard long").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write into a new folder below the shared one and read back; the folder then goes."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    found = durable(read(write(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), id_col, text_col), id_col))
    remove(docs.sparkSession, folder)
    return found
