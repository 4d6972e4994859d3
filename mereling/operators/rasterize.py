"""Vector layers as row spans: which pixels of each raster row a layer covers.

A layer is a table of parts: `kind` (of GeoJSON) and `rings`, arrays of (x, y) in map units; a polygon's rings are
its outer one and its holes, a line is one ring, a point one of one vertex. Each edge gives a row for each raster row
that it meets, never for what lies between: edges of polygons the place where they cross the row's centre line
(pairs of crossings are inside, even-odd over all rings of a part), buffered edges the interval of that line
within the buffer. Spans are clipped to the raster before anything is exploded, and merged to disjoint ones, so
a pixel meets at most one. The work follows edges and rows, not the extent of a polygon.

A pixel is covered if its centre is: in (x0, x1] of a pair of crossings, as scan conversion has it, or within the
buffer, its border included. Lines and points without a buffer cover nothing.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mereling.functions import crs, grid as chunks

POINTS = "array<struct<x:double,y:double>>"
RINGS = f"array<{POINTS}>"


@dataclass(frozen=True)
class Grid:
    """A raster's rows and columns, its affine transform (x = c + a column, y = f + e row), and its coordinate system."""

    height: int
    width: int
    a: float = 1.0
    c: float = 0.0
    e: float = 1.0
    f: float = 0.0
    crs: str = "EPSG:4326"

    @classmethod
    def of(cls, row: Row) -> "Grid":
        """From a row of `scenes.metadata`."""
        t = row["transform"]
        return cls(row["height"], row["width"], t["a"], t["c"], t["e"], t["f"], row["crs"])

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top."""
        x, y = sorted((self.c, self.c + self.a * self.width)), sorted((self.f, self.f + self.e * self.height))
        return x[0], y[0], x[1], y[1]


def layer_of(features: DataFrame, kind: str) -> DataFrame:
    """Rows with `vertices` as a layer of one kind."""
    return features.select("*", F.lit(kind).alias("kind"), F.array("vertices").alias("rings"))


def extent(rings: Column) -> Column:
    """(left, bottom, right, top) of a part."""
    every = F.flatten(rings)
    side = lambda f, axis: f(F.transform(every, lambda v: v[axis]))
    return F.struct(side(F.array_min, "x").alias("left"), side(F.array_min, "y").alias("bottom"), side(F.array_max, "x").alias("right"), side(F.array_max, "y").alias("top"))


def within_bounds(layer: DataFrame, bounds: tuple[float, float, float, float], margin: float = 0.0) -> DataFrame:
    """Parts whose extent meets a box that is wider by a margin."""
    left, bottom, right, top = bounds
    box = layer.withColumn("_box", extent(F.col("rings")))
    return box.where((F.col("_box.right") >= left - margin) & (F.col("_box.left") <= right + margin) & (F.col("_box.top") >= bottom - margin) & (F.col("_box.bottom") <= top + margin)).drop("_box")


def fitted(layer: DataFrame, grid: Grid, source: str, buffer: float = 0.0, strict_bbox: bool = False) -> DataFrame:
    """A layer's parts in the raster's system, of those that can touch it.

    The box is wider by the buffer; strict_bbox takes the bare image, so a part outside whose buffer reaches in is left out.
    """
    moved = layer.withColumn("rings", F.transform("rings", lambda r: crs.points(r, source, grid.crs)))
    return within_bounds(moved, grid.bounds, 0.0 if strict_bbox else buffer)


def edges(layer: DataFrame) -> DataFrame:
    """part, closed, ax, ay, bx, by: every edge of every ring; a ring of one vertex gives one of no length.

    Edges are dealt to all tasks: a layer is often one small file, but each edge has a row for each raster row that it meets.
    """
    parts = layer.select(F.monotonically_increasing_id().alias("part"), F.col("kind").endswith("Polygon").alias("closed"), "rings")  # numbered before rings are
    rows = parts.select("part", "closed", F.explode("rings").alias("ring")).where(F.size("ring") > 0)
    rows = rows.select("part", "closed", "ring", F.posexplode("ring").alias("i", "p"))
    following = F.get("ring", F.col("i") + 1)
    end = F.coalesce(following, F.when(F.col("closed") | (F.size("ring") == 1), F.get("ring", F.lit(0))))
    every = rows.select("part", "closed", "p", end.alias("q")).where("q is not null").select("part", "closed", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))
    return every.repartition("ax", "ay", "bx", "by")


def _rows(first: Column, last: Column, height: int) -> Column:
    """A raster row for each from first to last that the raster has."""
    low, high = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(height - 1)).cast("int")
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def _spans(rows: DataFrame, grid: Grid) -> DataFrame:
    return rows.select("y", F.greatest("x0", F.lit(0)).cast("int").alias("x0"), F.least("x1", F.lit(grid.width - 1)).cast("int").alias("x1")).where("x0 <= x1")


def filled(every: DataFrame, grid: Grid) -> DataFrame:
    """(y, x0, x1) inside polygons: pairs of crossings with each row's centre line."""
    px, py = (lambda c: (F.col(c) - grid.c) / grid.a), (lambda c: (F.col(c) - grid.f) / grid.e)
    own = every.where("closed").select("part", px("ax").alias("ax"), py("ay").alias("ay"), px("bx").alias("bx"), py("by").alias("by")).where("ay <> by")
    low, high = F.ceil(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5) - 1
    crossed = own.withColumn("y", _rows(low, high, grid.height))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    order = Window.partitionBy("part", "y").orderBy("x")
    pairs = crossed.select("part", "y", at.alias("x")).select("y", "x", F.lead("x").over(order).alias("to"), F.row_number().over(order).alias("n")).where("n % 2 = 1")
    inside = lambda c: F.least(F.greatest(F.floor(F.col(c) - 0.5), F.lit(-1)), F.lit(grid.width))
    return _spans(pairs.select("y", (inside("x") + 1).alias("x0"), inside("to").alias("x1")), grid)


def stroked(every: DataFrame, grid: Grid, buffer: float) -> DataFrame:
    """(y, x0, x1) within `buffer` map units of an edge: on a row's centre line that is one interval.

    Its ends lie on the circle around either end of the edge or on one of the edge's two parallels.
    """
    ends = [(F.least("ay", "by") - buffer - grid.f) / grid.e, (F.greatest("ay", "by") + buffer - grid.f) / grid.e]
    near = every.withColumn("y", _rows(F.ceil(F.least(*ends) - 0.5), F.floor(F.greatest(*ends) - 0.5), grid.height))
    line = grid.f + (F.col("y") + 0.5) * grid.e
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    near = near.select("*", line.alias("line"), (buffer / F.nullif(length, F.lit(0.0))).alias("unit"))
    reach = lambda c: F.when(F.abs(F.col("line") - F.col(c)) <= buffer, F.sqrt(F.greatest(F.lit(buffer * buffer) - (F.col("line") - F.col(c)) ** 2, F.lit(0.0))))

    def parallel(side: int) -> Column:
        dx, dy = -side * F.col("unit") * (F.col("by") - F.col("ay")), side * F.col("unit") * (F.col("bx") - F.col("ax"))
        t = (F.col("line") - F.col("ay") - dy) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
        return F.when((t >= 0) & (t <= 1), F.col("ax") + dx + t * (F.col("bx") - F.col("ax")))

    near = near.select("y", "ax", "bx", reach("ay").alias("ra"), reach("by").alias("rb"), parallel(1).alias("p1"), parallel(-1).alias("p2"))
    places = [F.col("ax") - F.col("ra"), F.col("ax") + F.col("ra"), F.col("bx") - F.col("rb"), F.col("bx") + F.col("rb"), F.col("p1"), F.col("p2")]
    # A generator of one row: no filter or projection moves below it, so the formulas stay single and small enough to be compiled.
    near = near.select("y", F.inline(F.array(F.struct(F.least(*places).alias("low"), F.greatest(*places).alias("high")))))
    px = [(F.col("low") - grid.c) / grid.a, (F.col("high") - grid.c) / grid.a]
    bound = lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(float(grid.width)))
    return _spans(near.select("y", F.ceil(bound(F.least(*px) - 0.5)).alias("x0"), F.floor(bound(F.greatest(*px) - 0.5)).alias("x1")), grid)


def merged(spans: DataFrame) -> DataFrame:
    """Spans as disjoint ones that don't touch."""
    order = Window.partitionBy("y").orderBy("x0", "x1")
    upto = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.coalesce(F.col("x0") > upto + 1, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    return rows.groupBy("y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def spans(layer: DataFrame, grid: Grid, buffer: float = 0.0, source: str | None = None, strict_bbox: bool = False) -> DataFrame:
    """y, x0, x1 (inclusive): the pixels that a layer covers, in disjoint spans. buffer: in map units of the raster.

    source: the layer's coordinate system; None: the raster's.
    """
    every = edges(fitted(layer, grid, source or grid.crs, buffer, strict_bbox))
    out = filled(every, grid)
    return merged(out.union(stroked(every, grid, buffer)) if buffer > 0 else out)


def meet(raster: DataFrame, covered: DataFrame, how: str, x: str = "x", y: str = "y", side: int = 256) -> DataFrame:
    """Pixels that are (left_semi) or aren't (left_anti) in spans: an equi-join by row and `side` columns, then the span."""
    cells = covered.select(F.col("y").alias("_y"), "x0", "x1", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))).alias("_cx"))
    on = (raster[y] == cells["_y"]) & (F.floor(raster[x] / side) == cells["_cx"]) & (raster[x] >= cells["x0"]) & (raster[x] <= cells["x1"])
    return raster.join(cells, on, how)


def mask_blocks(blocks: DataFrame, covered: DataFrame, grid: Grid, n_chunks: int, inside: bool = True) -> DataFrame:
    """Blocks (..., chunk, h, w, px) with null where spans are (inside=False: where they aren't).

    Spans are cut at the chunks' columns and meet the blocks by chunk; a block has at most h * w / 2 of them.
    """
    k = chunks.per_side(n_chunks)
    row, width = chunks.part(F.col("y"), F.lit(grid.height), k), F.lit(grid.width)
    first, last = chunks.part(F.col("x0"), width, k), chunks.part(F.col("x1"), width, k)
    cut = covered.select("y", "x0", "x1", row.alias("_row"), F.explode(F.sequence(first, last)).alias("_col"))
    start, end = chunks.part_start(F.col("_col"), width, k), chunks.part_start(F.col("_col") + 1, width, k)
    own = cut.select((F.col("_row") * k + F.col("_col")).cast("int").alias("_chunk"), F.struct(
        (F.col("y") - chunks.part_start(F.col("_row"), F.lit(grid.height), k)).cast("int").alias("y"), (F.greatest("x0", start) - start).cast("int").alias("x0"), (F.least(F.col("x1"), end - 1) - start).cast("int").alias("x1")).alias("s"))
    lists = own.groupBy("_chunk").agg(F.collect_list("s").alias("_spans"))
    joined = blocks.join(lists, blocks["chunk"] == lists["_chunk"], "left").select(*blocks.columns, F.col("_spans.y").alias("_y"), F.col("_spans.x0").alias("_x0"), F.col("_spans.x1").alias("_x1"))
    names, at = blocks.columns, {n: i for i, n in enumerate(joined.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (h, w) in enumerate(zip(batch.column(at["h"]).to_pylist(), batch.column(at["w"]).to_pylist(), strict=True)):
                edge = np.zeros(h * w + 1, np.int32)
                y, x0, x1 = (np.asarray(batch.column(at[n])[i].values if batch.column(at[n])[i].is_valid else [], dtype=np.int64) for n in ("_y", "_x0", "_x1"))
                np.add.at(edge, y * w + x0, 1)
                np.add.at(edge, y * w + x1 + 1, -1)
                hide = (np.cumsum(edge[:-1]) > 0) == inside
                px = batch.column(at["px"])[i].values
                valid = ~np.asarray(px.is_null()) & ~hide
                out.append(pa.array(np.asarray(px.to_numpy(zero_copy_only=False), np.float64), mask=~valid))
            offsets = np.concatenate(([0], np.cumsum([len(o) for o in out]))).astype(np.int32)
            px = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(out) if out else pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([px if n == "px" else batch.column(at[n]) for n in names], names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'px' else f.dataType.simpleString()}" for f in blocks.schema)
    return joined.mapInArrow(run, schema)


def nearest_class(raster: DataFrame, grid: Grid, cover: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """`raster` with the row and column (cover_y, cover_x) of another grid's cell that each pixel's centre lies in: nearest neighbour.

    Null outside the other grid. The centre goes through both transforms and, where they differ, both systems.
    """
    rows = raster.withColumns({"_mx": grid.c + (F.col(x) + 0.5) * grid.a, "_my": grid.f + (F.col(y) + 0.5) * grid.e})
    if crs.normal(grid.crs) != crs.normal(cover.crs):
        rows = rows.withColumn("_at", crs.point(F.col("_mx"), F.col("_my"), grid.crs, cover.crs)).withColumns({"_mx": F.col("_at.x"), "_my": F.col("_at.y")}).drop("_at")
    held = lambda v, n: F.when((v >= 0) & (v < n), v)
    cx, cy = F.floor((F.col("_mx") - cover.c) / cover.a), F.floor((F.col("_my") - cover.f) / cover.e)
    return rows.withColumns({"cover_y": held(cy, cover.height), "cover_x": held(cx, cover.width)}).drop("_mx", "_my")


def window(grid: Grid, cover: Grid) -> tuple[int, int, int, int]:
    """Rows y0 to y1 and columns x0 to x1 (exclusive) of another grid that a raster's bounds need, with one cell to spare."""
    left, bottom, right, top = crs.bounds(*grid.bounds, grid.crs, cover.crs)
    xs, ys = sorted(((left - cover.c) / cover.a, (right - cover.c) / cover.a)), sorted(((bottom - cover.f) / cover.e, (top - cover.f) / cover.e))
    cut = lambda v, n: int(min(max(v, 0), n))
    return cut(ys[0] - 1, cover.height), cut(ys[1] + 2, cover.height), cut(xs[0] - 1, cover.width), cut(xs[1] + 2, cover.width)


def without_cover(raster: DataFrame, land_cover: DataFrame, classes: tuple[int, ...], grid: Grid, cover: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels whose nearest cell of `land_cover` (y, x, class, on the grid `cover`) is none of `classes`; pixels outside it stay.

    The window of the land cover is a filter on its rows and columns, so it reaches the scan.
    """
    y0, y1, x0, x1 = window(grid, cover)
    bad = land_cover.where(F.col("class").isin(*classes) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    bad = bad.select(F.col("y").alias("_by"), F.col("x").alias("_bx"))
    placed = nearest_class(raster, grid, cover, x, y)
    return placed.join(bad, (placed["cover_y"] == bad["_by"]) & (placed["cover_x"] == bad["_bx"]), "left_anti").drop("cover_y", "cover_x")
