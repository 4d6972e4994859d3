"""TIFF rasters as a data source: a row per tile or strip, of which only those in the asked window are read.

The layout comes from the file's directory: tiles or strips, one or many samples, no compression, LZW or deflate, with
or without horizontal differencing, in either byte order. A partition is a range of tiles of one file; its
task reads the directory and then the bytes of its own tiles, by offset. Comparisons of y0, y1, x0, x1 and band with
constants are pushed down: tiles that fail them are never read, so the bytes read follow the window.
"""

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from mereling.operators.rasterize import Grid
from mereling.sources.paths import file_system

#: Tiles of a partition, and bytes of the directory's values that are read at once.
TILES = 64
SCHEMA = "path string, band int, tile int, y0 int, y1 int, x0 int, x1 int, px array<double>"
# Fixed values of the format: tags, sizes of value types, and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIE, GEO_KEYS, PROJECTED, GEOGRAPHIC = 322, 323, 324, 325, 339, 33550, 33922, 34735, 3072, 2048
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
PLAIN, LZW, DEFLATE = (1,), (5,), (8, 32946)


class Layout:
    """What the first directory of a file says."""

    def __init__(self, file):
        head = file.read(8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or struct.unpack(self.order + "H", head[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        file.seek(struct.unpack(self.order + "I", head[4:8])[0])
        n = struct.unpack(self.order + "H", file.read(2))[0]
        raw, self.tags = file.read(12 * n), {}
        for i in range(n):
            tag, kind, count = struct.unpack(self.order + "HHI", raw[12 * i : 12 * i + 8])
            if kind in SIZES:
                code, size = SIZES[kind]
                data = raw[12 * i + 8 : 12 * i + 12]
                if count * size > 4:
                    file.seek(struct.unpack(self.order + "I", data)[0])
                    data = file.read(count * size)
                self.tags[tag] = struct.unpack(f"{self.order}{count}{code}", data[: count * size])
        one = lambda tag, default=None: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.samples, self.compression, self.predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if self.compression not in (*PLAIN, *LZW, *DEFLATE) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression}, predictor {self.predictor} can't be read")
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 1) // 8))
        tiled = TILE_OFFSETS in self.tags
        self.offsets, self.sizes = self.tags[TILE_OFFSETS if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES]
        self.w, self.h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (self.width, min(one(ROWS, self.height), self.height))
        self.tiled, self.apart = tiled, self.samples > 1 and one(PLANAR, 1) == 2
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)

    def bands(self, tile: int) -> range:
        """The bands that a tile holds."""
        return range(tile // (self.across * self.down), tile // (self.across * self.down) + 1) if self.apart else range(self.samples)

    def place(self, tile: int) -> tuple[int, int, int, int]:
        """y0, y1, x0, x1 of a tile, within the image."""
        row, col = divmod(tile % (self.across * self.down), self.across)
        return row * self.h, min((row + 1) * self.h, self.height), col * self.w, min((col + 1) * self.w, self.width)

    def pixels(self, tile: int, data: bytes) -> np.ndarray:
        """A tile's values, cut to the image: (rows, columns, samples)."""
        y0, y1, x0, x1 = self.place(tile)
        n = 1 if self.apart else self.samples
        rows = self.h if self.tiled else y1 - y0
        raw = unlzw(data) if self.compression in LZW else zlib.decompress(data) if self.compression in DEFLATE else data
        values = np.frombuffer(raw, self.dtype, rows * self.w * n).reshape(rows, self.w, n)
        if self.predictor == 2:  # differences to the left, in the type's own arithmetic
            values = np.add.accumulate(values.astype(self.dtype.newbyteorder("=")), axis=1, dtype=self.dtype.newbyteorder("="))
        return values[: y1 - y0, : x1 - x0]

    def grid(self) -> Grid:
        """The raster's grid, from its scale, tie point and coordinate system."""
        sx, sy = self.tags.get(SCALE, (1.0, -1.0))[:2]
        i, j, _, x, y = self.tags.get(TIE, (0.0, 0.0, 0.0, 0.0, 0.0))[:5]
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        return Grid(self.height, self.width, sx, x - i * sx, -sy, y + j * sy, f"EPSG:{codes.get(PROJECTED) or codes.get(GEOGRAPHIC) or 4326}")


def unlzw(data: bytes) -> bytes:
    """Variable-width codes from the most significant bit on; widths grow one code early, as in this format."""
    clear, end = 256, 257
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, width, bits, held = list(first), [], b"", 9, 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == end:
            break
        if code == clear:
            table, width, last = list(first), 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _paths(path: str) -> list[str]:
    """The files of a path, in its own naming."""
    fs, place = file_system(path)
    if fs.get_file_info(place).type == pyarrow.fs.FileType.File:
        return [path]
    found = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(place, recursive=True)) if i.is_file and i.path.lower().endswith((".tif", ".tiff"))]
    return [path.rstrip("/") + f[len(place.rstrip("/")) :] for f in sorted(found)]


@dataclass
class _Tiles(InputPartition):
    path: str
    tiles: list[int]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.filters = options["path"], []

    def pushFilters(self, filters: list) -> Iterator:
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in tests and len(f.attribute) == 1 and f.attribute[0] in ("y0", "y1", "x0", "x1", "band", "tile"):
                self.filters.append((f.attribute[0], tests[type(f)], f.value))
            else:
                yield f

    def _wanted(self, layout: Layout, tile: int) -> list[int]:
        """The bands of a tile that pass the filters."""
        fields = dict(zip(("y0", "y1", "x0", "x1"), layout.place(tile), strict=True)) | {"tile": tile}
        return [b for b in layout.bands(tile) if all(test((fields | {"band": b})[name], value) for name, test, value in self.filters)]

    def partitions(self) -> list[_Tiles]:
        out = []
        for path in _paths(self.path):
            fs, place = file_system(path)
            with fs.open_input_file(place) as file:
                layout = Layout(file)
            tiles = [t for t in range(len(layout.offsets)) if self._wanted(layout, t)]
            out += [_Tiles(path, tiles[i : i + TILES]) for i in range(0, len(tiles), TILES)]
        return out or [_Tiles("", [])]

    def read(self, partition: _Tiles) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        fs, place = file_system(partition.path)
        schema = pa.schema([("path", pa.string()), *((n, pa.int32()) for n in ("band", "tile", "y0", "y1", "x0", "x1")), ("px", pa.list_(pa.float64()))])
        with fs.open_input_file(place) as file:
            layout = Layout(file)
            for tile in partition.tiles:
                file.seek(layout.offsets[tile])
                values = layout.pixels(tile, file.read(layout.sizes[tile]))
                for band in self._wanted(layout, tile):
                    px = np.ascontiguousarray(values[:, :, 0 if layout.apart else band], np.float64).ravel()
                    lists = pa.ListArray.from_arrays(pa.array([0, len(px)], pa.int32()), pa.array(px))
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path]), *(pa.array([v], pa.int32()) for v in (band, tile, *layout.place(tile))), lists], schema=schema)


class Tiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read_tiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, band, tile, y0, y1, x0, x1 (exclusive ends), px (row-major doubles) of a file's or folder's tiles that meet a window y0, y1, x0, x1."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiff)
    rows = spark.read.format("tiff_tiles").option("path", path).load()
    if window is None:
        return rows
    y0, y1, x0, x1 = window
    return rows.where((rows.y1 > y0) & (rows.y0 < y1) & (rows.x1 > x0) & (rows.x0 < x1))


def grid_of(path: str) -> Grid:
    """The grid of one file."""
    fs, place = file_system(path)
    with fs.open_input_file(place) as file:
        return Layout(file).grid()
