"""Media columns: TIFF in a binary column, one row per page.

The reader walks the chain of image directories of either byte order, decodes strips and tiles that
are stored plain, with PackBits, LZW or deflate, undoes horizontal differencing, joins planes, and gives each
page's samples row by row: a byte a sample of 1, 2, 4 or 8 bits, two (little-endian) of 16. The writer makes
files of 8-bit samples, so that any bytes can be kept as pages without loss.

Edge cases: a null or empty binary has no page; a file that breaks the format, claims more samples than its
bytes can hold, or has samples of another kind, yields one row with its error and no samples, never a
failure of the job; a directory chain that loops ends where it would repeat. An empty table gives an empty
result; repeated rows and ids are rows of their own, equal files have equal pages; pages of one file come in
order. A task holds one file at a time, and one page of it decoded, however long the texts or files are.
Other columns are left out unless asked for, whatever their names. No rule needs ties.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes that a stored byte can become at most, by compression: a run of 128 of two bytes, 4094 bytes of a code
#: of 12 bits, 258 bytes of two bits.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2730, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Sizes of the field types 1 to 13.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}
#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339


def pack_bits(data: bytes) -> bytes:
    """PackBits of one row: runs of 3 and longer are repeats, the rest literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(a)))
    out, literal = bytearray(), 0  # literal: where the pending literal begins

    def flush(end: int) -> None:
        for k in range(literal, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    long = np.flatnonzero(lengths >= 3)
    for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        flush(s)
        literal = s + n
        while n > 0:
            k = min(n, 128)
            if k == 1:
                out += bytes([0, data[s]])
            else:
                out += bytes([257 - k, data[s]])
            n -= k
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """The format's LZW: codes high bit first, 9 to 12 bits, widened one code early."""
    table = {bytes([i]): i for i in range(256)}
    fresh = dict(table)
    acc, bits, width, n = 256, 9, 9, 258
    out = bytearray()
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        acc = acc << width | table[word]
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
        table[longer] = n
        n += 1
        if n == 4095:
            acc = acc << width | 256
            bits += width
            table, n, width = dict(fresh), 258, 9
        elif n + 1 > 1 << width:
            width += 1
        word = data[k : k + 1]
    if word:
        acc = acc << width | table[word]
        bits += width
        n += 1
        if n + 1 > 1 << width and width < 12:
            width += 1
    acc = acc << width | 257
    bits += width
    acc <<= -bits % 8
    bits += -bits % 8
    return bytes(out) + (acc & (1 << bits) - 1).to_bytes(bits // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(fresh), 9, b""
    out, acc, bits, length = [], 0, 0, 0
    for byte in data:
        acc = acc << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        if code == 257 or length >= size:
            break
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("LZW code beyond the table")
        if last:
            table.append(last + word[:1])
        out.append(word)
        length += len(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _decoded(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression}")


def _encoded(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def write_tiff(pages: list[tuple[bytes, int]], compression: int = DEFLATE, predictor: bool = False, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of grey 8-bit pages, each given as (samples, width)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for data, width in pages:
        image = np.frombuffer(data, np.uint8).reshape(-1, width)
        height = len(image)
        if tile:
            th, tw = tile
            cells = [np.pad(c, ((0, th - c.shape[0]), (0, tw - c.shape[1]))) for y in range(0, height, th) for x in range(0, width, tw) for c in [image[y : y + th, x : x + tw]]]
        else:
            cells = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places, counts = [], []
        for c in cells:
            if predictor:
                c = np.concatenate([c[:, :1], np.diff(c, axis=1)], axis=1)
            rows = np.ascontiguousarray(c)
            stored = b"".join(pack_bits(row.tobytes()) for row in rows) if compression == PACKBITS else _encoded(rows.tobytes(), compression)
            places.append(len(out))
            counts.append(len(stored))
            out += stored
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        if predictor:
            fields.append((PREDICTOR, 3, [2]))
        entries = []
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += packed
            else:
                entries.append(struct.pack("<HHI4s", tag, kind, len(values), packed.ljust(4, b"\0")))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """Integer fields of each image directory of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("no TIFF head")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        fields = {0: [order == ">"]}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind not in _CODE:
                continue
            place = at + 10 + 12 * k
            if _SIZE[kind] * count > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{_CODE[kind]}", data, place))
        yield fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _cells(f: dict[int, list[int]], width: int, height: int, planes: int, size: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(plane, y, x, height, width, offset, bytes) of each strip or tile, after a check of their number."""
    if TILE_OFFSETS in f:
        tw, th = f[TILE_WIDTH][0], f[TILE_HEIGHT][0]
        places, counts, fixed = f[TILE_OFFSETS], f[TILE_COUNTS], True
    else:
        tw, th = width, min(f.get(ROWS_PER_STRIP, [height])[0], height) or height
        places, counts, fixed = f[STRIP_OFFSETS], f[STRIP_COUNTS], False
    if not tw or not th:
        raise ValueError("cells without extent")
    across, down = -(-width // tw), -(-height // th)
    if len(places) != len(counts) or len(places) != across * down * planes:
        raise ValueError("another number of strips or tiles than the page needs")
    if any(p + n > size for p, n in zip(places, counts, strict=True)):
        raise ValueError("strips or tiles beyond the file")
    for k, (place, count) in enumerate(zip(places, counts, strict=True)):
        plane, at = divmod(k, across * down)
        y, x = at // across * th, at % across * tw
        yield plane, y, x, th if fixed else min(th, height - y), tw, place, count


def _samples(raw: bytes, h: int, w: int, spp: int, bits: int, big: bool) -> np.ndarray:
    """A cell's decoded bytes as an array (h, w, spp); rows begin at whole bytes."""
    if bits == 16:
        return np.frombuffer(raw, ">u2" if big else "<u2", h * w * spp).reshape(h, w, spp).astype("<u2")
    if bits == 8:
        return np.frombuffer(raw, np.uint8, h * w * spp).reshape(h, w, spp)
    stride = -(-w * spp * bits // 8)
    rows = np.unpackbits(np.frombuffer(raw, np.uint8, h * stride).reshape(h, stride), axis=1)
    values = rows[:, : w * spp * bits].reshape(h, w * spp, bits)
    return np.packbits(np.pad(values, ((0, 0), (0, 0), (8 - bits, 0))), axis=2).reshape(h, w, spp)


def read_page(data: bytes, f: dict[int, list[int]]) -> tuple[int, int, int, bytes]:
    """Width, height, samples per pixel and samples of one directory's page."""
    width, height, spp = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
    depths = set(f.get(BITS, [1]))
    bits = depths.pop() if len(depths) == 1 else 0
    if bits not in (1, 2, 4, 8, 16) or f.get(FORMAT, [1])[0] != 1:
        raise ValueError("samples of another kind than whole numbers of 1, 2, 4, 8 or 16 bits")
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31 or not 0 < spp < 1 << 16:
        raise ValueError("a page without extent")
    planar = f.get(PLANAR, [1])[0] == 2
    compression, predictor = f.get(COMPRESSION, [NONE])[0], f.get(PREDICTOR, [1])[0]
    if compression not in EXPANSION or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"compression {compression}, predictor {predictor}")
    planes, deep = (spp, 1) if planar else (1, spp)
    stored = sum(f[TILE_COUNTS] if TILE_OFFSETS in f else f[STRIP_COUNTS])
    if width * height * spp * bits > 8 * EXPANSION[compression] * min(stored, len(data)):
        raise ValueError("more samples than the stored bytes can hold")
    image = np.zeros((height, width, spp), "<u2" if bits == 16 else np.uint8)
    for plane, y, x, h, w, place, count in _cells(f, width, height, planes, len(data)):
        size = h * -(-w * deep * bits // 8)
        if size > EXPANSION[compression] * count:
            raise ValueError("a cell larger than its bytes can hold")
        cell = _samples(_decoded(data[place : place + count], compression, size), h, w, deep, bits, bool(f[0][0]))
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=cell.dtype)
        image[y : y + h, x : x + w, plane if planar else slice(None)] = cell[: height - y, : width - x, 0 if planar else slice(None)]
    return width, height, spp, image.tobytes()


#: Bytes of samples, about, and pages of a batch of rows.
BATCH_BYTES, BATCH_PAGES = 4 << 20, 512
_PAGE = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("samples", pa.binary()), ("error", pa.string())]


def file_pages(data: bytes | None) -> Iterator[tuple]:
    """The pages of one file as tuples in the order of _PAGE; the last one has the error, if there is any."""
    page = 0
    try:
        for f in directories(data) if data else ():
            w, h, spp, samples = read_page(data, f)
            yield page, w, h, spp, f.get(BITS, [1])[0], f.get(COMPRESSION, [NONE])[0], samples, None
            page += 1
    except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        yield page, None, None, None, None, None, None, repr(e)


def pages(files: DataFrame, id_col: str, media_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id_col, the columns to keep, page (from 0), width, height, samples_per_pixel, bits,
    compression, samples (binary), error. Pages of a file follow each other in one partition."""
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = files.select(F.col(id_col).alias("id"), *carried, F.col(media_col).alias("media"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [batch.schema.field(k) for k in range(batch.num_columns - 1)]
            schema = pa.schema([*head, *_PAGE])
            out, size = [], 0
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in range(len(head)))
                for page in file_pages(batch.column(len(head))[i].as_py()):
                    out.append((*key, *page))
                    size += len(page[6] or b"")
                    if size > BATCH_BYTES or len(out) >= BATCH_PAGES:
                        yield _batch(out, schema)
                        out, size = [], 0
            yield _batch(out, schema)

    kinds = "page int, width int, height int, samples_per_pixel int, bits int, compression int, samples binary, error string"
    found = rows.mapInArrow(read, f"{ddl}, {kinds}")
    return found.toDF(id_col, *keep, *(n for n, _ in _PAGE))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Width of a page that keeps text, and its most rows.
LINE = 576
ROWS = 1024


#: Forms of stored texts, one in as many texts each.
FORMS = (
    dict(compression=LZW),
    dict(compression=LZW, predictor=True),
    dict(compression=PACKBITS),
    dict(compression=DEFLATE),
    dict(compression=DEFLATE, predictor=True),
    dict(compression=DEFLATE, predictor=True, tile=(96, 96)),
    dict(compression=PACKBITS, tile=(16, 288)),
    dict(compression=NONE),
)


def store(payload: bytes) -> bytes:
    """Bytes as a file: pages of LINE samples a row. The checksum deals the forms out evenly, so equal bytes
    give equal files."""
    size = LINE * ROWS
    return write_tiff([(payload[k : k + size], LINE) for k in range(0, len(payload), size)], **FORMS[zlib.crc32(payload) % len(FORMS)])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % LINE if raw else LINE)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_bytes, media (a TIFF file that keeps the padded text), its bytes and hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = [("n_bytes", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _stored(batch)
            while part := list(islice(made, 256)):
                yield _batch(part, pa.schema([batch.schema.field(0), *schema]))

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary, media_bytes long, media_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _stored(batch: pa.RecordBatch) -> Iterator[tuple]:
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        n, payload = padded(text.as_py())
        media = store(payload)
        yield key.as_py(), n, media, len(media), hashlib.sha256(media).hexdigest()


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep every text as media, read its pages back and compute features of what was read: the pages of a
    file follow each other, so each is folded as it comes and a text's pages are never held together."""
    kind = docs.schema[id_col].dataType.simpleString()
    kept = ("n_bytes", "media_bytes", "media_sha256")
    found = pages(text_media(docs, id_col, text_col), id_col, "media", kept)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: _File | None = None
        key = pa.null()
        for batch in batches:
            key, out = batch.schema.field(0).type, []
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                i, n, size, sha, page, width, _, _, _, form, samples, error = (x.as_py() for x in row)
                if error is not None:
                    raise ValueError(f"a text's own file does not read back: {error}")
                if page == 0:
                    out += [file.row()] if file else []
                    file = _File(i, n, size, sha, form)
                file.add(samples, width)
            yield _batch(out, pa.schema([("id", key), *zip(names[1:], types, strict=True)]))
        if file:
            yield _batch([file.row()], pa.schema([("id", key), *zip(names[1:], types, strict=True)]))

    out = found.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


class _File:
    """What a stored text's pages add up to."""

    def __init__(self, key, n: int, media_bytes: int, media_sha: str, form: int):
        self.key, self.n, self.media_bytes, self.media_sha, self.form = key, n, media_bytes, media_sha, form
        self.sha, self.tail, self.size, self.pages, self.total, self.edges = hashlib.sha256(), b"", 0, 0, 0, 0

    def add(self, samples: bytes, width: int) -> None:
        self.sha.update(samples)
        self.tail = (self.tail + samples[-32:])[-32:]
        self.size += len(samples)
        self.pages += 1
        a = np.frombuffer(samples, np.uint8).reshape(-1, width)
        self.total += int(a.sum(dtype=np.int64))
        self.edges += int(np.count_nonzero(a[:, 1:] != a[:, :-1]))

    def row(self) -> tuple:
        feature = f"pages={self.pages};width={LINE};height={self.size // LINE};compression={self.form};sum={self.total};edges={self.edges}"
        return self.key, self.n, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), self.media_bytes, self.media_sha, feature
