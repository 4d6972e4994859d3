"""Rasters as tables: band alignment, masks, indices and temporal composites.

Two layouts have one meaning: a row per pixel, for clarity and SQL, and a row per block (arrays
of a chunk's pixels), for scale. A composite shuffles once, on the pixel or on the chunk.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mereling.functions import grid, pixels


def align_bands(long: DataFrame, bands: tuple[str, ...] = ("green", "nir", "red"), keys: tuple[str, ...] = ("scene", "y", "x")) -> DataFrame:
    """Rows of (keys, band, dn) as one row per pixel with a column per band."""
    return long.groupBy(*keys).pivot("band", list(bands)).agg(F.max("dn"))


def mask_classes(raster: DataFrame, classes: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("scene", "y", "x"), hidden: tuple[int, ...] = pixels.CLOUD_CLASSES) -> DataFrame:
    """`raster` with null in `columns` where `classes` (keys, cls) is one of `hidden`; pixels without a class are clear."""
    joined = raster.join(classes.select(*keys, F.col("cls").alias("_cls")), list(keys), "left")
    return joined.withColumns({c: pixels.unless(F.col("_cls").isin(*hidden), F.col(c)) for c in columns}).drop("_cls")


def zero_where(raster: DataFrame, probability: DataFrame, column: str, factor: int = 2, above: float = 50, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """`raster` with 0 where a coarser layer (keys, cy, cx, prob), `factor` pixels to one, is above a value."""
    on = [raster[k] == probability[k] for k in keys] + [F.floor(raster["y"] / factor) == probability["cy"], F.floor(raster["x"] / factor) == probability["cx"]]
    joined = raster.join(probability, on, "left")
    return joined.select(*(raster[c] for c in raster.columns if c != column), F.when(F.coalesce(probability["prob"], F.lit(0)) > above, 0).otherwise(raster[column]).alias(column))


def upscale(raster: DataFrame, factor: int = 2) -> DataFrame:
    """Each pixel as factor x factor pixels."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    grown = raster.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    return grown.withColumns({"y": F.col("y") * factor + F.col("_dy"), "x": F.col("x") * factor + F.col("_dx")}).drop("_dy", "_dx")


def _statistics(value: Column) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q.alias("_q"), F.avg(value).alias("mean")]


def composite(raster: DataFrame, value: str = "v", keys: tuple[str, ...] = ("index_name", "y", "x"), strict: bool = False) -> DataFrame:
    """p25, median, p75 and mean of each pixel over time, one row per key.

    Nulls are left out; a pixel without a value has nulls. strict: a pixel with any null has no
    percentiles (its mean stays).
    """
    grouped = raster.groupBy(*keys).agg(*_statistics(F.col(value)), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all"))
    at = lambda i: F.when(F.col("_n") == F.col("_all"), F.get("_q", F.lit(i))) if strict else F.get("_q", F.lit(i))
    return grouped.select(*keys, at(0).alias("p25"), at(1).alias("median"), at(2).alias("p75"), "mean")


def composite_mean(raster: DataFrame, value: str = "v", keys: tuple[str, ...] = ("index_name", "y", "x")) -> DataFrame:
    return raster.groupBy(*keys).agg(F.avg(value).alias("mean"))


def matching_scenes(raster: DataFrame, index: str = "index_name") -> DataFrame:
    """`raster` without the indices whose scenes differ in size (rows, columns)."""
    sizes = raster.groupBy(index, "scene").agg(F.max("y").alias("h"), F.max("x").alias("w"), F.count(F.lit(1)).alias("n"))
    odd = sizes.groupBy(index).agg(F.countDistinct("h", "w", "n").alias("k")).where("k > 1").select(index)
    return raster.join(odd, index, "left_anti")


def composite_blocks(blocks: DataFrame, keys: tuple[str, ...] = ("index_name", "chunk")) -> DataFrame:
    """Blocks (keys, scene, px array<double>) as one row per key: p25, median, p75, mean arrays.

    A group is the scenes of one chunk: as many blocks as scenes, each of one chunk's pixels. Blocks
    with `at` (see `to_blocks`) may lack pixels, each others; the result then has all places, in order.
    """
    placed = "at" in blocks.columns
    schema = blocks.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", p25 array<double>, median array<double>, p75 array<double>, mean array<double>" + (", at array<struct<y:int,x:int>>" if placed else "")

    def run(table: pa.Table) -> pa.Table:
        lists = table["px"].combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null is NaN
        if placed:
            cells = table["at"].combine_chunks().flatten()
            y, x = (np.asarray(cells.field(i), np.int64) for i in range(2))
            every, column = np.unique(np.stack((y, x)), axis=1, return_inverse=True)
            stack = np.full((len(table), every.shape[1]), np.nan)
            stack[np.repeat(np.arange(len(table)), np.asarray(lists.value_lengths())), column.ravel()] = flat
        else:
            stack = flat.reshape(len(table), -1)
        empty = np.isnan(stack).all(axis=0)
        stack[:, empty] = 0.0
        rows = [*np.nanpercentile(stack, [25, 50, 75], axis=0), np.nanmean(stack, axis=0)]
        lists = [pa.array([pa.array(np.where(empty, np.nan, r), from_pandas=True).to_pylist()], pa.list_(pa.float64())) for r in rows]
        names = [*keys, "p25", "median", "p75", "mean"]
        if placed:
            kind = pa.struct([("y", pa.int32()), ("x", pa.int32())])
            lists.append(pa.array([[{"y": int(a), "x": int(b)} for a, b in every.T]], pa.list_(kind)))
            names.append("at")
        return pa.Table.from_arrays([table[k].slice(0, 1) for k in keys] + lists, names)

    return blocks.groupBy(*keys).applyInArrow(run, schema)


def to_blocks(raster: DataFrame, value: str = "v", keys: tuple[str, ...] = ("index_name", "scene", "chunk")) -> DataFrame:
    """Pixels as blocks in row-major order, with their places `at`. A group is one chunk of one scene."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    return raster.groupBy(*keys).agg(cells.alias("_cells")).select(*keys, F.transform("_cells", lambda c: c["v"]).alias("px"), F.transform("_cells", lambda c: F.struct(c["y"].cast("int").alias("y"), c["x"].cast("int").alias("x"))).alias("at"))


def fill_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (..., h, w, cells array<struct<i,v>>) with px, all h * w pixels, in place of cells; null where no cell is."""
    rest = [f for f in blocks.schema if f.name != "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, out = batch.column("cells"), []
            size = np.asarray(batch.column("h"), np.int64) * np.asarray(batch.column("w"), np.int64)
            for k, n in enumerate(size.tolist()):
                px = np.full(n, np.nan)
                if cells[k].is_valid:
                    own = cells[k].values
                    px[np.asarray(own.field("i"))] = np.asarray(own.field("v"), float)
                out.append(pa.array(px, from_pandas=True))
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays(out) if out else pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), lists], [*(f.name for f in rest), "px"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return blocks.mapInArrow(run, StructType([*rest, StructField("px", ArrayType(DoubleType()))]))


def read_window(blocks: DataFrame, height: int, width: int, n_chunks: int, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """The pixels (y, x, v and the blocks' other columns) of a half-open window of a raster that is stored as blocks (chunk, h, w, px, ...).

    Chunks outside the window aren't read: the range of chunk numbers reaches the scan.
    """
    k = grid.per_side(n_chunks)

    def reach(low: int, high: int, n: int) -> tuple[int, int]:
        starts = [p * (n // k) + min(p, n % k) for p in range(k)]
        return bisect_right(starts, max(low, 0)) - 1, bisect_right(starts, min(high, n) - 1) - 1

    (r0, r1), (c0, c1) = reach(y0, y1, height), reach(x0, x1, width)
    row, col = F.floor(F.col("chunk") / k), F.col("chunk") % k
    near = blocks.where(F.col("chunk").between(r0 * k + c0, r1 * k + c1) & row.between(r0, r1) & col.between(c0, c1))
    rest = [c for c in blocks.columns if c not in ("h", "w", "px")]
    cells = near.select(*rest, "w", grid.part_start(row, F.lit(height), k).alias("_y"), grid.part_start(col, F.lit(width), k).alias("_x"), F.posexplode("px").alias("_i", "v"))
    cells = cells.withColumns({"y": F.col("_y") + F.floor(F.col("_i") / F.col("w")), "x": F.col("_x") + F.col("_i") % F.col("w")})
    return cells.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).select(*rest, "y", "x", "v")


def bounds(raster: DataFrame, value: str = "v", share: float = pixels.LABEL_SHARE) -> DataFrame:
    """One row: the least value, and a share of the greatest; null and 0 without any."""
    return raster.agg(F.min(value).alias("low"), F.coalesce(F.lit(share) * F.max(value), F.lit(0.0)).alias("high"))


def to_grey(raster: DataFrame, value: str = "v", share: float = pixels.LABEL_SHARE) -> DataFrame:
    """`raster` with `grey`, its value on the scale of the whole raster's bounds."""
    one = bounds(raster, value, share)
    return raster.crossJoin(F.broadcast(one)).withColumn("grey", pixels.to_grey(F.col(value), F.col("low"), F.col("high"))).drop("low", "high")  # one row


def valid_chunks(raster: DataFrame, value: str = "v", scene: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with any value: (scene, chunk, n_valid, greatest, ordinal), numbered from 0 within the scene.

    The window runs over one row per chunk of a scene (4,900 at full scale).
    """
    from pyspark.sql import Window

    counted = raster.groupBy(*scene, "chunk").agg(F.count(value).alias("n_valid"), F.max(value).alias("greatest")).where("n_valid > 0")
    order = Window.partitionBy(*scene).orderBy("chunk") if scene else Window.partitionBy(F.lit(0)).orderBy("chunk")
    return counted.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))


def cloud_classes(blocks: DataFrame, predictor, bands: tuple[str, ...] = ("red", "green", "nir")) -> DataFrame:
    """Blocks (scene, chunk, h, w and an array per band) with `cls`, from any model.

    predictor: takes a float array (bands, h, w) and returns an integer array (h, w); it runs on
    the executors, one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                stack = np.array([row[b] for b in bands], float).reshape(len(bands), row["h"], row["w"])
                out.append(np.asarray(predictor(stack)).astype(int).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "cls"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return blocks.mapInArrow(run, StructType([*blocks.schema.fields, StructField("cls", ArrayType(IntegerType()))]))
