import struct
import zlib

import numpy as np
import pytest

from tessella.sources import slides as W
from tessella.sources import tiff as T


def by_hand(a, order="<", big=False, strips=5, planar=False, predictor=False, deflate=False):
    """A file of strips written another way than the library's own."""
    h, w, c = a.shape
    kind = np.dtype(f"{order}u{a.itemsize}")
    word = "Q" if big else "I"
    body = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)))
    offsets, sizes = [], []
    for planes in [a[:, :, k : k + 1] for k in range(c)] if planar else [a]:
        for y in range(0, h, strips):
            part = planes[y : y + strips]
            if predictor:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            raw = part.astype(kind).tobytes()
            raw = zlib.compress(raw) if deflate else raw
            offsets.append(len(body))
            sizes.append(len(raw))
            body += raw
    fields = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * a.itemsize] * c), (259, "H", [8 if deflate else 1]), (270, "s", b"about\0"), (273, word, offsets), (277, "H", [c]), (278, "H", [strips]), (279, word, sizes), (284, "H", [2 if planar else 1]), (317, "H", [2 if predictor else 1])]
    entries = b""
    room = struct.calcsize(word)
    for tag, letter, values in fields:
        raw = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(raw) > room:
            place = len(body)
            body += raw
            raw = struct.pack(order + word, place)
        entries += struct.pack(f"{order}HH{word}", tag, {"H": 3, "I": 4, "Q": 16, "s": 2}[letter], len(values)) + raw.ljust(room, b"\0")
    at = len(body)
    body += struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + struct.pack(order + word, 0)
    body[8 if big else 4 : 16 if big else 8] = struct.pack(order + word, at)
    return bytes(body)


def put_together(tiles, shape, kind):
    out = np.zeros(shape, kind)
    for y, x, h, w, data in tiles:
        out[y : y + h, x : x + w] = np.frombuffer(data, kind.newbyteorder("<")).reshape(shape[2], h, w).transpose(1, 2, 0)
    return out


@pytest.mark.parametrize("settings", [{}, {"order": ">"}, {"big": True, "deflate": True}, {"planar": True, "order": ">", "big": True}, {"predictor": True, "deflate": True}], ids=str)
@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_files_written_by_hand(settings, kind):
    a = np.random.default_rng(1).integers(0, 255, (13, 17, 3)).astype(kind)
    file = T.Tiff(by_hand(a, **settings))
    assert np.array_equal(put_together(file.tiles(file.series[0][0]), a.shape, np.dtype(kind)), a)
    assert file.rows("p") == [("p", 0, 0, 17, 13, 3, 8 * a.itemsize, 17, 5, 8 if settings.get("deflate") else 1, "about")]


def test_errors():
    with pytest.raises(ValueError, match="not a TIFF"):
        T.Tiff(b"hello, world")
    file = T.Tiff(by_hand(np.zeros((2, 2, 1), np.uint8)).replace(struct.pack("<HHII", 259, 3, 1, 1), struct.pack("<HHII", 259, 3, 1, 7)))
    with pytest.raises(ValueError, match="compression 7"):
        list(file.tiles(file.series[0][0]))


def test_a_pyramid_as_a_file(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 256, (3, 70, 90)).astype(np.uint8)
    pixels = spark.createDataFrame([(int(c), int(y), int(x), int(a[c, y, x])) for c, y, x in np.ndindex(a.shape)], "c long, y long, x long, v long")
    from pyspark.sql import functions as F

    levels = W.tiled(W.auto_pyramid(pixels, (2, 2)), 32, 3, by=("level",)).withColumn("image", F.lit("s1")).persist()
    (path,) = T.write_tiffs(levels, str(tmp_path / "out"), 3, 32, text="<xml/>")
    assert path.endswith("s1.tif")
    pages = T.tiff_pages(spark, path).orderBy("level").collect()
    assert [(p.series, p.level, p.width, p.height, p.channels, p.bits, p.tile_width, p.description) for p in pages] == [(0, 0, 90, 70, 3, 8, 32, "<xml/>"), (0, 1, 45, 35, 3, 8, 32, ""), (0, 2, 23, 18, 3, 8, 32, "")]
    key = lambda r: (r.level, r.y, r.x)
    read = {key(r): (r.h, r.w, bytes(r.data)) for r in T.tiff_tiles(spark, path).collect()}
    assert read == {key(r): (r.h, r.w, bytes(r.data)) for r in levels.collect()}
    assert {r.level for r in T.tiff_tiles(spark, path, levels=(1,)).collect()} == {1} and T.tiff_tiles(spark, path, series=3).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        T.write_tiffs(levels, str(tmp_path / "out"), 3, 32)
