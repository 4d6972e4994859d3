"""TIFF tiles and strips against arrays, in files that are written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from mereling.sources import tiff


def lzw(data):
    """The format's compression, with a clear code whenever the table is full."""
    out, bits, held = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9
    size = 258

    def put(code):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    word = b""
    for b in data:
        more = word + bytes([b])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([b])
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def write(path, image, order="<", tile=None, rows=None, compression=1, predictor=1, apart=False, geo=False):
    height, width, samples = image.shape
    h, w = tile or (rows, width)
    dtype = image.dtype.newbyteorder(order)
    pack, parts = {1: lambda d: d, 5: lzw, 8: zlib.compress}[compression], []
    for planes in ([image[:, :, b : b + 1] for b in range(samples)] if apart else [image]):
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = planes[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1).astype(image.dtype)
                parts.append(pack(np.ascontiguousarray(block).astype(dtype).tobytes()))
    at = np.cumsum([8, *map(len, parts)]).tolist()
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [image.dtype.itemsize * 8] * samples), 259: ("H", [compression]), 277: ("H", [samples]), 284: ("H", [2 if apart else 1]), 317: ("H", [predictor]), 339: ("H", [kind] * samples)}
    tags |= {322: ("I", [w]), 323: ("I", [h]), 324: ("I", at[:-1]), 325: ("I", [len(p) for p in parts])} if tile else {273: ("I", at[:-1]), 278: ("I", [h]), 279: ("I", [len(p) for p in parts])}
    if geo:
        tags |= {33550: ("d", [10.0, 20.0, 0.0]), 33922: ("d", [2.0, 1.0, 0.0, 300_020.0, 5_900_000.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32631])}
    directory, extra, end = b"", b"", at[-1] + 2 + 12 * len(tags) + 4
    for tag, (code, values) in sorted(tags.items()):
        data = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(data) > 4:
            place = struct.pack(order + "I", end + len(extra))
            extra += data
            data = place
        directory += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[code], len(values)) + data.ljust(4, b"\0")
    magic = {"<": b"II", ">": b"MM"}[order]
    path.write_bytes(magic + struct.pack(order + "HI", 42, at[-1]) + b"".join(parts) + struct.pack(order + "H", len(tags)) + directory + b"\0" * 4 + extra)


def image_of(kind, height, width, samples=1, seed=0):
    r = np.random.default_rng(seed)
    smooth = np.add.accumulate(r.integers(-3, 4, (height, width, samples)), axis=1) + 500
    return (smooth / 7).astype(kind) if np.dtype(kind).kind == "f" else smooth.astype(kind)


def joined(rows, image):
    out = np.full(image.shape, np.nan)
    for r in rows:
        out[r.y0 : r.y1, r.x0 : r.x1, r.band] = np.array(r.px).reshape(r.y1 - r.y0, r.x1 - r.x0)
    return out


@pytest.mark.parametrize("options", [
    dict(tile=(16, 32)), dict(tile=(16, 16), compression=5), dict(tile=(32, 16), compression=8, predictor=2), dict(rows=7), dict(rows=50, compression=5, predictor=2, order=">"), dict(rows=9, compression=8, apart=True), dict(tile=(16, 16), order=">", apart=True)])
def test_layouts(spark, tmp_path, options):
    for i, (kind, samples) in enumerate((("u2", 1), ("u1", 3), ("f4", 2), ("i4", 1))):
        if options.get("predictor") == 2 and kind == "f4":
            continue
        image = image_of(kind, 50, 71, samples, i)
        write(tmp_path / f"{i}.tif", image, **options)
        got = tiff.read_tiff(spark, str(tmp_path / f"{i}.tif")).collect()
        assert np.array_equal(joined(got, image), image.astype(float)), (kind, options)


def test_lzw_of_many_codes():
    r = np.random.default_rng(1)
    for n, high in ((0, 2), (1, 2), (40_000, 3), (60_000, 256), (5000, 1)):
        data = r.integers(0, high, n).astype(np.uint8).tobytes()
        assert tiff.unlzw(lzw(data)) == data


def test_only_the_window_is_read(spark, tmp_path, monkeypatch):
    image = image_of("u2", 512, 640)
    write(tmp_path / "a.tif", image, tile=(64, 64))
    rows = tiff.read_tiff(spark, str(tmp_path), (70, 130, 200, 260))
    assert {(r.y0, r.x0) for r in rows.collect()} == {(64, 192), (64, 256), (128, 192), (128, 256)}
    assert "PythonFilter" not in rows._jdf.queryExecution().executedPlan().toString()
    whole = joined(rows.collect(), image)[70:130, 200:260, 0]
    assert np.array_equal(whole, image[70:130, 200:260, 0].astype(float))
    reader, seen = tiff.TiffReader({"path": str(tmp_path)}), []
    pixels = tiff.Layout.pixels
    monkeypatch.setattr(tiff.Layout, "pixels", lambda self, tile, data: (seen.append(len(data)), pixels(self, tile, data))[1])
    for filters, tiles in (([("y1", tiff.GreaterThan, 70), ("y0", tiff.LessThan, 130), ("x1", tiff.GreaterThan, 200), ("x0", tiff.LessThan, 260)], 4), ([], 80), ([("y0", tiff.EqualTo, 64)], 10), ([("y0", tiff.LessThan, 0)], 0)):
        reader, seen[:] = tiff.TiffReader({"path": str(tmp_path)}), []
        assert list(reader.pushFilters([kind((name,), value) for name, kind, value in filters])) == []
        parts = reader.partitions()
        assert sum(b.num_rows for p in parts for b in reader.read(p)) == tiles == len(seen) and sum(seen) == tiles * 64 * 64 * 2
        assert max(len(p.tiles) for p in parts) <= tiff.TILES


def test_grid_and_errors(spark, tmp_path):
    write(tmp_path / "g.tif", image_of("u1", 8, 9), rows=8, geo=True)
    grid = tiff.grid_of(str(tmp_path / "g.tif"))
    assert (grid.height, grid.width, grid.a, grid.e, grid.c, grid.f, grid.crs) == (8, 9, 10.0, -20.0, 300_000.0, 5_900_020.0, "EPSG:32631")
    (tmp_path / "bad.tif").write_bytes(b"no TIFF at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.grid_of(str(tmp_path / "bad.tif"))
    empty = tmp_path / "none"
    empty.mkdir()
    assert tiff.read_tiff(spark, str(empty)).count() == 0
