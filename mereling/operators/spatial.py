"""Rasters and vectors: known features masked, land cover, and crops by boxes.

Layers become row spans (see `rasterize`) that pixels meet by an equi-join. Crops meet pixels in square cells.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mereling.operators import rasterize
from mereling.operators.rasterize import Grid

VERTICES = "array<struct<x:double,y:double>>"


def _cells(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))


def segments(vertices: Column) -> Column:
    """The segments (a, b) of a polyline; a single point is one of no length."""
    n = F.size(vertices)
    ahead = F.slice(vertices, 2, F.greatest(n - 1, F.lit(0)))
    return F.when(n == 1, F.arrays_zip(vertices.alias("a"), vertices.alias("b"))).otherwise(F.arrays_zip(F.slice(vertices, 1, F.greatest(n - 1, F.lit(0))).alias("a"), ahead.alias("b")))


def _span(edges: Column, axis: str, buffer: float) -> tuple[Column, Column]:
    ends = F.transform(edges, lambda e: F.struct(F.least(e["a"][axis], e["b"][axis]).alias("low"), F.greatest(e["a"][axis], e["b"][axis]).alias("high")))
    return F.array_min(F.transform(ends, lambda e: e["low"])) - buffer, F.array_max(F.transform(ends, lambda e: e["high"])) + buffer


def outside_buffer(raster: DataFrame, layer: DataFrame, buffer: float, grid: Grid, source: str | None = None, strict_bbox: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels whose centres are farther than `buffer` map units from everything in a layer; all pixels if it is empty."""
    return rasterize.meet(raster, rasterize.spans(layer, grid, buffer, source, strict_bbox), "left_anti", x, y)


def covered(raster: DataFrame, layer: DataFrame, grid: Grid, source: str | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels whose centres are in a polygon of a layer: with land polygons, the sea is masked. All pixels if no polygon meets the raster."""
    if rasterize.fitted(layer, grid, source or grid.crs).isEmpty():
        return raster
    return rasterize.meet(raster, rasterize.spans(layer, grid, source=source), "left_semi", x, y)


def without_classes(raster: DataFrame, land_cover: DataFrame, classes: tuple[int, ...], keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Pixels whose land cover is none of `classes`."""
    return raster.join(land_cover.where(F.col("class").isin(*classes)).select(*keys), list(keys), "left_anti")


def crop(raster: DataFrame, windows: DataFrame, id_col: str, side: int = 16) -> DataFrame:
    """The pixels of each half-open window (id, y0, y1, x0, x1): id, y and x within the window, and the pixel's columns.

    Empty windows give nothing. A hot window is as many rows as it has pixels.
    """
    cells = windows.where("y1 > y0 and x1 > x0").withColumn("cy", _cells(F.col("y0"), F.col("y1") - 1, side)).withColumn("cx", _cells(F.col("x0"), F.col("x1") - 1, side))
    on = (F.floor(raster["y"] / side) == cells["cy"]) & (F.floor(raster["x"] / side) == cells["cx"]) & (
        (raster["y"] >= cells["y0"]) & (raster["y"] < cells["y1"]) & (raster["x"] >= cells["x0"]) & (raster["x"] < cells["x1"]))
    rest = [raster[c] for c in raster.columns if c not in ("y", "x")]
    return raster.join(cells, on).select(cells[id_col], (raster["y"] - cells["y0"]).alias("y"), (raster["x"] - cells["x0"]).alias("x"), *rest)


def in_bounds(features: DataFrame, left: float, bottom: float, right: float, top: float, strict: bool = False) -> DataFrame:
    """Features (vertices) whose extent meets a bounding box; strict: lies in it."""
    low_x, high_x = _span(segments(F.col("vertices")), "x", 0.0)
    low_y, high_y = _span(segments(F.col("vertices")), "y", 0.0)
    if strict:
        return features.where((low_x >= left) & (high_x <= right) & (low_y >= bottom) & (high_y <= top))
    return features.where((high_x >= left) & (low_x <= right) & (high_y >= bottom) & (low_y <= top))


def to_pixels(features: DataFrame, transform: Column) -> DataFrame:
    """`features` with vertices in pixels: the inverse of a raster's affine transform a, c, e, f."""
    cell = lambda v: F.struct(((v["x"] - transform["c"]) / transform["a"]).alias("x"), ((v["y"] - transform["f"]) / transform["e"]).alias("y"))
    return features.withColumn("vertices", F.transform("vertices", cell))


def mask_features(raster: DataFrame, layers: dict[str, DataFrame | None], grid: Grid, river_buffer: float = 20.0, reservoir_buffer: float = 50.0, urban: tuple[int, ...] = (20, 21), systems: dict[str, str] | None = None, cover: Grid | None = None, strict_bbox: bool = False) -> DataFrame:
    """Rivers, then sea, then known reservoirs, then towns masked; a layer that is missing is passed over.

    layers: rivers, land and reservoirs as layers (see `rasterize`), land_cover as rows (y, x, class). Buffers are in
    the map units of the raster (metres for UTM). systems: the layers' coordinate systems, where they aren't the raster's.
    cover: the grid of land_cover, if it isn't the raster's.
    """
    out, systems = raster, systems or {}
    if layers.get("rivers") is not None:
        out = outside_buffer(out, layers["rivers"], river_buffer, grid, systems.get("rivers"), strict_bbox)
    if layers.get("land") is not None:
        out = covered(out, layers["land"], grid, systems.get("land"))
    if layers.get("reservoirs") is not None:
        out = outside_buffer(out, layers["reservoirs"], reservoir_buffer, grid, systems.get("reservoirs"), strict_bbox)
    if layers.get("land_cover") is not None:
        out = without_classes(out, layers["land_cover"], urban) if cover is None else rasterize.without_cover(out, layers["land_cover"], urban, grid, cover)
    return out
