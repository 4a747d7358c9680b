"""Foreign and forged TIFF files: other sample sizes, planes, byte orders, and sizes that are not there."""

import struct

import numpy as np
import pytest

from turnlake.llm import tiff


def made(width, height, strips, fields=(), order="<", bits=8, compression=1, spp=1):
    """A file of one directory; strips are stored as they are."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    places = []
    for s in strips:
        places.append(len(out))
        out += s
    out += b"\0" * (len(out) % 2)
    rows = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * spp), 259: (3, [compression]), 262: (3, [1]), 273: (4, places), 277: (3, [spp]), 278: (4, [height]), 279: (4, [len(s) for s in strips])}
    rows.update(dict(fields))
    entries = []
    for tag, (kind, values) in sorted(rows.items()):
        packed = struct.pack(f"{order}{len(values)}{tiff._CODE[kind]}", *values)
        if len(packed) > 4:
            entries.append(struct.pack(f"{order}HHII", tag, kind, len(values), len(out)))
            out += packed + b"\0" * (len(packed) % 2)
        else:
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
    struct.pack_into(f"{order}I", out, 4, len(out))
    return bytes(out) + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def pages(data):
    return list(tiff.file_pages(data))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples(bits):
    values = np.arange(5 * 3).reshape(3, 5) % (1 << bits)
    packed = b"".join(np.packbits(np.unpackbits(r.astype(np.uint8)[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes() for r in values)
    (page,) = pages(made(5, 3, [packed], bits=bits))
    assert page[:6] == (0, 5, 3, 1, bits, 1) and page[6] == values.astype(np.uint8).tobytes()


@pytest.mark.parametrize("order", ["<", ">"])
def test_sixteen_bits_of_either_order_with_differences(order):
    values = np.array([[1000, 2000, 65535], [0, 300, 7]], np.uint16)
    differences = np.concatenate([values[:, :1], np.diff(values, axis=1)], axis=1).astype(f"{order}u2")
    (page,) = pages(made(3, 2, [differences.tobytes()], [(317, (3, [2]))], order, bits=16))
    assert page[4] == 16 and page[6] == values.astype("<u2").tobytes()


def test_planes_are_joined():
    red, green = bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])
    (page,) = pages(made(2, 2, [red, green], [(284, (3, [2]))], spp=2))
    assert page[3] == 2 and page[6] == bytes([1, 5, 2, 6, 3, 7, 4, 8])


@pytest.mark.parametrize(
    "data",
    [
        made(1 << 20, 1 << 20, [b"x"], compression=8),
        made(1 << 20, 1 << 20, [b"x"], compression=5),
        made(1 << 31, 1 << 31, [b"x"] * 2, compression=32773),
        made(4, 4, [b"x" * 16], [(278, (4, [1]))]),
        made(4, 4, [b"x" * 16], [(279, (4, [1 << 30]))]),
        made(0, 4, [b""]),
        made(4, 4, [b"x" * 16], [(322, (4, [0])), (323, (4, [0])), (324, (4, [8])), (325, (4, [16]))]),
        made(4, 4, [b"x" * 16], [(322, (4, [1 << 30])), (323, (4, [1 << 30])), (324, (4, [8])), (325, (4, [16]))], compression=8),
        made(4, 4, [b"x" * 64], [(339, (3, [3]))]),
        made(4, 4, [b"x" * 16], bits=32),
        made(4, 4, [b"x" * 7]),
        made(4, 4, [b"x" * 16], compression=7),
        b"II*\0\xff\xff\xff\xff",
        b"II*\0",
    ],
)
def test_forged_files_have_an_error(data):
    found = pages(data)
    assert len(found) == 1 and found[0][6] is None and found[0][7]


def test_forged_files_beside_good_ones(spark):
    good = tiff.write_tiff([(bytes(range(100)), 10)], tiff.LZW)
    files = spark.createDataFrame([(1, good, "a"), (2, made(1 << 20, 1 << 20, [b"x"], compression=8), "b"), (2, good, "c"), (None, good, None)], "file_id long, media binary, note string")
    rows = [(r.file_id, r.note, r.page, r.width, bool(r.error)) for r in tiff.pages(files, "file_id", "media", ("note",)).collect()]
    assert sorted(rows, key=repr) == sorted([(1, "a", 0, 10, False), (2, "b", 0, None, True), (2, "c", 0, 10, False), (None, None, 0, 10, False)], key=repr)


def test_forms_are_dealt_evenly():
    forms = [tiff.store(f"text {k}".encode() * 30 + b"\xff" * ((-len(f"text {k}".encode() * 30)) % 576)) for k in range(1600)]
    of = [next(tiff.directories(f)) for f in forms]
    count = {}
    for f in of:
        key = (f[tiff.COMPRESSION][0], f.get(tiff.PREDICTOR, [1])[0], tiff.TILE_OFFSETS in f)
        count[key] = count.get(key, 0) + 1
    assert len(count) == len(tiff.FORMS) and min(count.values()) > 140


def test_long_texts_have_many_pages(spark):
    text = "abc déf " * 200_000
    df = spark.createDataFrame([(1, text), (2, None), (1, "x")], "doc_id long, text string")
    rows = tiff.digest(df).collect()
    assert len(rows) == 3 and max(int(r.feature.split(";")[0].split("=")[1]) for r in rows) == -(-len(text.encode()) // (576 * 1024))
