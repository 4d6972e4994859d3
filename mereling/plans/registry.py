"""All raster queries by name, and their SQL for DuckDB where SQL expresses them."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.config import CLASS_NAMES
from mereling.functions import crs, grid, names, pixels
from mereling.operators import clouds, evaluation, labels, model, predictions, raster, rasterize, spatial
from mereling.plans import bindings as b
from mereling.sources import images, scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- pixels and composites


@query(f"WITH {b.PIXELS_SQL} SELECT scene, tile, y, x, CAST(green - nir AS DOUBLE) / nullif(green + nir, 0) AS ndwi FROM pixels")
def ndwi_pixels(spark, d):
    return b.scenes_pixels(spark, d).select("scene", "tile", "y", "x", pixels.ndwi(F.col("green"), F.col("nir")).alias("ndwi"))


@query(f"""WITH {b.PIXELS_SQL} SELECT scene, y, x, CAST(nir - green AS DOUBLE) / nullif(nir + green, 0) AS ndvi,
  round(2.4 * CAST(nir - green AS DOUBLE) / nullif(nir + green + 1, 0), 9) AS evi2 FROM pixels""")
def vegetation_indices(spark, d):
    return b.scenes_pixels(spark, d).select("scene", "y", "x", pixels.ndvi(F.col("nir"), F.col("green")).alias("ndvi"), F.round(pixels.evi2(F.col("nir"), F.col("green")), 9).alias("evi2"))


@query(f"""WITH {b.PIXELS_SQL} SELECT scene, y, x, round(CAST(2.5 AS DOUBLE) * (nir - green) / nullif(nir + CAST(6 AS DOUBLE) * green - CAST(7.5 AS DOUBLE) * (green // 2) + 1, 0), 6) AS evi FROM pixels""")
def enhanced_index(spark, d):
    return b.scenes_pixels(spark, d).select("scene", "y", "x", F.round(pixels.evi(F.col("nir"), F.col("green"), F.floor(F.col("green") / 2)), 6).alias("evi"))


@query(f"""WITH {b.PIXELS_SQL}, long AS (SELECT scene, y, x, 'green' AS band, green AS dn FROM pixels UNION ALL SELECT scene, y, x, 'nir', nir FROM pixels)
  SELECT scene, y, x, max(CASE WHEN band = 'green' THEN dn END) AS green, max(CASE WHEN band = 'nir' THEN dn END) AS nir FROM long GROUP BY scene, y, x""")
def band_alignment(spark, d):
    p = b.scenes_pixels(spark, d)
    long = p.select("scene", "y", "x", F.explode(F.array(F.struct(F.lit("green").alias("band"), F.col("green").alias("dn")), F.struct(F.lit("nir").alias("band"), F.col("nir").alias("dn")))).alias("s")).select("scene", "y", "x", "s.*")
    return raster.align_bands(long, ("green", "nir"))


@query(f"""WITH {b.PIXELS_SQL}, cloud AS (SELECT scene, y, x, 1 + (y * 8 + x) % 4 AS cls FROM pixels WHERE green > {b.CLOUD_DN})
  SELECT p.scene, p.y, p.x, CASE WHEN coalesce(c.cls, 0) NOT IN (1, 2, 3) THEN CAST(green - nir AS DOUBLE) / nullif(green + nir, 0) END AS ndwi
  FROM pixels p LEFT JOIN cloud c ON p.scene = c.scene AND p.y = c.y AND p.x = c.x""")
def cloud_masked_ndwi(spark, d):
    seen = raster.mask_classes(b.scenes_pixels(spark, d), b.scenes_cloud(spark, d), ("green", "nir"))
    return seen.select("scene", "y", "x", pixels.ndwi(F.col("green"), F.col("nir")).alias("ndwi"))


@query(f"""WITH {b.PIXELS_SQL}, s AS (SELECT scene, y, x, green + coalesce(lead(green) OVER (PARTITION BY scene, y ORDER BY x), 0) AS a, 2 * nir + 0.25 AS b FROM pixels)
  SELECT scene, y, x, CASE WHEN a >= b AND a >= 2000.5 THEN 0 WHEN b >= 2000.5 THEN 1 ELSE 2 END AS cls FROM s""")
def blended_clouds(spark, d):
    """Classes of a linear predictor that looks one pixel to the right, from overlapping patches: those of whole images."""
    blocks = raster.to_blocks(_with_chunk(b.scenes_pixels(spark, d)).select("scene", "chunk", "y", "x", F.col("green").cast("double").alias("v")), keys=("scene", "chunk")).withColumnRenamed("px", "green")
    other = raster.to_blocks(_with_chunk(b.scenes_pixels(spark, d)).select("scene", "chunk", "y", "x", F.col("nir").cast("double").alias("v")), keys=("scene", "chunk")).withColumnRenamed("px", "nir")
    both = blocks.select("scene", "chunk", "green").join(other.select("scene", "chunk", "nir"), ["scene", "chunk"]).withColumns({"h": F.lit(4), "w": F.lit(4)})
    got = clouds.blended_classes(both, _looks_right, 3, 8, 8, 4, 2, ("green", "nir"))
    cells = got.select("scene", "chunk", F.posexplode("cls").alias("i", "cls"))
    y, x = F.floor(F.col("chunk") / 2) * 4 + F.floor(F.col("i") / 4), F.col("chunk") % 2 * 4 + F.col("i") % 4
    return cells.select("scene", y.cast("int").alias("y"), x.cast("int").alias("x"), "cls")


def _looks_right(planes):
    right = np.zeros_like(planes[0])
    right[:, :-1] = planes[0, :, 1:]
    return np.stack((planes[0] + right, 2 * planes[1] + 0.25, np.full_like(right, 2000.5)))


COMPOSITE_SQL = f"""WITH {b.PIXELS_SQL} SELECT tile, y, x, (y * 2 // 8) * 2 + x * 2 // 8 AS chunk, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS p75, round(avg(v), 6) AS mean FROM masked GROUP BY tile, y, x"""


def _with_chunk(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", grid.chunk_of(F.col("y"), F.col("x"), F.lit(8), F.lit(8), 4).cast("int"))


@query(COMPOSITE_SQL)
def composite_percentiles(spark, d):
    return rounded(_with_chunk(raster.composite(b.masked_index(spark, d), keys=("tile", "y", "x"))), "p25", "median", "p75", "mean")


@query(COMPOSITE_SQL)
def composite_blocks(spark, d):
    """The same composite on blocks: a chunk's pixels are one array."""
    blocks = raster.to_blocks(_with_chunk(b.masked_index(spark, d)), keys=("tile", "scene", "chunk"))
    made = raster.composite_blocks(blocks.select("tile", "chunk", "scene", "px"), keys=("tile", "chunk"))
    cells = made.select("tile", "chunk", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("median") - 1).alias("i"), "p25", "median", "p75", "mean")).alias("s")).select("tile", "chunk", "s.*")
    y, x = F.floor(F.col("chunk") / 2) * 4 + F.floor(F.col("i") / 4), F.col("chunk") % 2 * 4 + F.col("i") % 4
    return rounded(cells.select("tile", y.cast("int").alias("y"), x.cast("int").alias("x"), "chunk", "p25", "median", "p75", "mean"), "p25", "median", "p75", "mean")


@query(f"""WITH {b.PIXELS_SQL} SELECT tile, y, x, CASE WHEN count(v) = count(*) THEN round(quantile_cont(v, 0.25), 6) END AS p25, CASE WHEN count(v) = count(*) THEN round(quantile_cont(v, 0.5), 6) END AS median,
  CASE WHEN count(v) = count(*) THEN round(quantile_cont(v, 0.75), 6) END AS p75, round(avg(v), 6) AS mean FROM masked GROUP BY tile, y, x""")
def composite_strict(spark, d):
    return rounded(raster.composite(b.masked_index(spark, d), keys=("tile", "y", "x"), strict=True), "p25", "median", "p75", "mean")


@query(f"WITH {b.PIXELS_SQL} SELECT tile, y, x, round(avg(v), 6) AS mean FROM masked GROUP BY tile, y, x")
def composite_mean(spark, d):
    return rounded(raster.composite_mean(b.masked_index(spark, d), keys=("tile", "y", "x")), "mean")


@query(f"""WITH {b.PIXELS_SQL}, sized AS (SELECT tile, scene, max(y) AS h, max(x) AS w, count(*) AS n FROM pixels WHERE NOT (tile = 3 AND scene % 2 = 1 AND y = 7) GROUP BY tile, scene),
  odd AS (SELECT tile FROM sized GROUP BY tile HAVING count(DISTINCT (h, w, n)) > 1)
  SELECT scene, tile, y, x, green FROM pixels WHERE NOT (tile = 3 AND scene % 2 = 1 AND y = 7) AND tile NOT IN (SELECT tile FROM odd)""")
def shape_mismatch_skip(spark, d):
    p = b.scenes_pixels(spark, d).where("not (tile = 3 and scene % 2 = 1 and y = 7)")
    return raster.matching_scenes(p, "tile").select("scene", "tile", "y", "x", "green")


@query(f"WITH {b.PIXELS_SQL} SELECT scene, y * 2 + dy AS y, x * 2 + dx AS x, green FROM pixels, unnest(range(2)) AS a(dy), unnest(range(2)) AS c(dx)")
def upscale_2x(spark, d):
    out = raster.upscale(b.scenes_pixels(spark, d).select("scene", "y", "x", "green"))
    return out.select("scene", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "green")


@query(f"""WITH {b.PIXELS_SQL}, coarse AS (SELECT scene, y AS cy, x AS cx, nir // 20 AS prob FROM pixels WHERE y < 4 AND x < 4)
  SELECT p.scene, p.y, p.x, CASE WHEN coalesce(c.prob, 0) > 50 THEN 0 ELSE p.green END AS green FROM pixels p LEFT JOIN coarse c ON p.scene = c.scene AND p.y // 2 = c.cy AND p.x // 2 = c.cx""")
def cloud_probability_zero(spark, d):
    p = b.scenes_pixels(spark, d)
    coarse = p.where("y < 4 and x < 4").select("scene", F.col("y").alias("cy"), F.col("x").alias("cx"), F.floor(F.col("nir") / 20).alias("prob"))
    return raster.zero_where(p.select("scene", "y", "x", "green"), coarse, "green")


# --- grid, boxes, crops


@query(f"""WITH {b.MOSAIC_SQL}, rows AS (SELECT y, ntile(7) OVER (ORDER BY y) - 1 AS part FROM (SELECT DISTINCT y FROM mosaic)),
  cols AS (SELECT x, ntile(7) OVER (ORDER BY x) - 1 AS part FROM (SELECT DISTINCT x FROM mosaic))
  SELECT m.event_id, m.y, m.x, r.part * 7 + c.part AS chunk, CAST(r.part AS INTEGER) AS chunk_row, CAST(c.part AS INTEGER) AS chunk_col FROM mosaic m JOIN rows r ON m.y = r.y JOIN cols c ON m.x = c.x""")
def grid_chunks(spark, d):
    m = b.mosaic(spark, d).withColumn("chunk", grid.chunk_of(F.col("y"), F.col("x"), F.col("h"), F.col("w"), 50))
    place = grid.chunk_place(F.col("chunk"), 7)
    return m.select("event_id", "y", "x", "chunk", place["row"].alias("chunk_row"), place["col"].alias("chunk_col"))


@query("""WITH sides AS (SELECT p_partkey, 100 + p_size AS h, 150 - p_size % 7 AS w FROM part)
  SELECT p_partkey, CAST(m AS INTEGER) AS minichunk, CAST(h * (m % 5) // 5 AS INTEGER) AS y0, CAST(h * (m % 5 + 1) // 5 AS INTEGER) AS y1, CAST(w * (m // 5) // 5 AS INTEGER) AS x0, CAST(w * (m // 5 + 1) // 5 AS INTEGER) AS x1
  FROM sides, unnest(range(25)) AS t(m)""")
def minichunk_windows(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.explode(grid.mini_windows(100 + F.col("p_size"), 150 - F.col("p_size") % 7)).alias("w")).select("p_partkey", "w.*")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_quantity * 2 AS ulx, l_discount * 1000 AS uly, l_quantity + l_tax * 1500 AS lrx, l_quantity * 3 AS lry FROM lineitem),
  lo AS (SELECT *, least(greatest((ulx + lrx) / 2 - 15.7, 0.0), 125.6) AS x, least(greatest((uly + lry) / 2 - 15.7, 0.0), 125.6) AS y FROM s)
  SELECT l_orderkey, l_partkey, CASE WHEN ulx < lrx AND uly < lry THEN round(x, 6) END AS ulx, CASE WHEN ulx < lrx AND uly < lry THEN round(y, 6) END AS uly,
  CASE WHEN ulx < lrx AND uly < lry THEN round(x + 31.4, 6) END AS lrx, CASE WHEN ulx < lrx AND uly < lry THEN round(y + 31.4, 6) END AS lry FROM lo""")
def fixed_boxes(spark, d):
    q = F.col("l_quantity")
    box = F.struct((q * 2).alias("ulx"), (F.col("l_discount") * 1000).alias("uly"), (q + F.col("l_tax") * 1500).alias("lrx"), (q * 3).alias("lry"))
    out = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", box.alias("s")).select("l_orderkey", "l_partkey", grid.fixed_box(F.col("s")).alias("box"))
    return rounded(out.select("l_orderkey", "l_partkey", "box.*"), "ulx", "uly", "lrx", "lry")


def _drawn(what: str, n: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || ':{what}'), 1, 6) AS BIGINT) % {n})"


_RANDOM_SQL = f"""drawn AS (SELECT c_custkey, {_drawn('x0', '157')} AS x0, {_drawn('y0', '157')} AS y0, {_drawn('x1', '1048576')} AS rx, {_drawn('y1', '1048576')} AS ry, [{', '.join(_drawn(f'dx{i}', '3') for i in range(9))}] AS dx, [{', '.join(_drawn(f'dy{i}', '3') for i in range(9))}] AS dy FROM customer),
  box AS (SELECT *, x0 + 1 + rx % (157 - x0) AS x1, y0 + 1 + ry % (157 - y0) AS y1 FROM drawn)"""


@query(f"""WITH {_RANDOM_SQL}, p AS (SELECT c_custkey, i, x0 + (x1 - x0) / 3 * (i % 3) + dx[i + 1] AS x, y0 + (y1 - y0) / 3 * (i // 3) + dy[i + 1] AS y, (x1 - x0) / 3 AS w, (y1 - y0) / 3 AS h FROM box, unnest(range(9)) AS t(i))
  SELECT c_custkey, CAST(i AS INTEGER) AS part, round(least(greatest(x, 0.0), 157.0), 6) AS ulx, round(least(greatest(y, 0.0), 157.0), 6) AS uly, round(least(greatest(x + w, 0.0), 157.0), 6) AS lrx, round(least(greatest(y + h, 0.0), 157.0), 6) AS lry FROM p""")
def nine_boxes(spark, d):
    k = F.col("c_custkey")
    parts = b.table(spark, d, "customer").select("c_custkey", grid.random_box(k).alias("b")).select("c_custkey", F.posexplode(grid.nine_boxes(F.col("b"), k)).alias("part", "s"))
    return rounded(parts.select("c_custkey", "part", "s.*"), "ulx", "uly", "lrx", "lry")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, '[ ' || CAST(l_quantity AS INTEGER) || '.  ' || (l_partkey % 157) || '.5 ' || (l_suppkey % 90) || CASE WHEN l_linenumber = 3 THEN ' x]' WHEN l_linenumber = 4 THEN ']' ELSE ' 157. ]' END AS cell FROM lineitem),
  p AS (SELECT *, list_transform(regexp_split_to_array(trim(regexp_replace(cell, '[\\[\\]]', '', 'g')), '\\s+'), lambda v: TRY_CAST(v AS DOUBLE)) AS n FROM s),
  g AS (SELECT *, CASE WHEN len(list_filter(n, lambda v: v IS NULL)) > 0 THEN [] ELSE n END AS c FROM p)
  SELECT l_orderkey, l_partkey, l_linenumber, CAST(len(c) AS INTEGER) AS n, c[1] AS c1, c[2] AS c2, c[3] AS c3, c[4] AS c4 FROM g""")
def parse_coords(spark, d):
    cell = F.concat(F.lit("[ "), F.col("l_quantity").cast("int").cast("string"), F.lit(".  "), (F.col("l_partkey") % 157).cast("string"), F.lit(".5 "), (F.col("l_suppkey") % 90).cast("string"),
                    F.when(F.col("l_linenumber") == 3, " x]").when(F.col("l_linenumber") == 4, "]").otherwise(" 157. ]"))
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", grid.coords(cell).alias("c"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.size("c").alias("n"), *(F.get("c", F.lit(i)).alias(f"c{i + 1}") for i in range(4)))


@query(f"""WITH {b.MOSAIC_SQL}, box AS (SELECT s_suppkey, s_suppkey * 17 % w AS x0, s_suppkey * 23 % w AS y0, least(s_suppkey * 17 % w + 3 + s_suppkey % 6, w) AS x1, least(s_suppkey * 23 % w + 2 + s_suppkey % 5, w) AS y1 FROM supplier, side)
  SELECT s_suppkey, m.y - y0 AS y, m.x - x0 AS x, event_id, v FROM mosaic m JOIN box ON m.y >= y0 AND m.y < y1 AND m.x >= x0 AND m.x < x1""")
def crop_patches(spark, d):
    s = b.table(spark, d, "supplier").crossJoin(F.broadcast(b.mosaic_side(spark, d)))
    k, w = F.col("s_suppkey"), F.col("w")
    windows = s.select("s_suppkey", (k * 17 % w).alias("x0"), (k * 23 % w).alias("y0"), F.least(k * 17 % w + 3 + k % 6, w).alias("x1"), F.least(k * 23 % w + 2 + k % 5, w).alias("y1"))
    return spatial.crop(b.mosaic(spark, d).select("event_id", "y", "x", "v"), windows, "s_suppkey")


@query("""SELECT c_custkey, round(least(greatest(least(x0, x1), 0.0), 500.0) * 157 / 500, 6) AS ulx, round(least(greatest(least(y0, y1), 0.0), 500.0) * 157 / 500, 6) AS uly,
  round(least(greatest(greatest(x0, x1), 0.0), 500.0) * 157 / 500, 6) AS lrx, round(least(greatest(greatest(y0, y1), 0.0), 500.0) * 157 / 500, 6) AS lry
  FROM (SELECT c_custkey, c_acctbal / 10 AS x0, 300 - c_acctbal / 20 AS y0, CAST(c_custkey % 600 AS DOUBLE) AS x1, CAST(c_custkey % 510 AS DOUBLE) AS y1 FROM customer)""")
def roi_scaling(spark, d):
    c = b.table(spark, d, "customer")
    k = F.col("c_custkey")
    roi = grid.roi_to_pixels(F.col("c_acctbal") / 10, 300 - F.col("c_acctbal") / 20, (k % 600).cast("double"), (k % 510).cast("double"), F.lit(157))
    return rounded(c.select("c_custkey", roi.alias("r")).select("c_custkey", "r.*"), "ulx", "uly", "lrx", "lry")


@query("""SELECT c_custkey, CAST(300000 + c_custkey * 10 AS DOUBLE) AS left_edge, 5900040.0 + (c_custkey % 500) * -10.0 AS bottom_edge, 300000 + c_custkey * 10 + (100 + c_custkey % 50) * 10.0 AS right_edge, 5900040.0 AS top_edge FROM customer""")
def image_bounds(spark, d):
    k = F.col("c_custkey")
    t = F.struct(F.lit(10.0).alias("a"), (300000 + k * 10).cast("double").alias("c"), F.lit(-10.0).alias("e"), F.lit(5900040.0).alias("f"))
    got = b.table(spark, d, "customer").select("c_custkey", t.alias("t")).select("c_custkey", grid.image_bounds(F.col("t"), 100 + k % 50, k % 500).alias("g"))
    return got.select("c_custkey", F.col("g.left").alias("left_edge"), F.col("g.bottom").alias("bottom_edge"), F.col("g.right").alias("right_edge"), F.col("g.top").alias("top_edge"))


# --- scales and chunks


@query(f"""WITH {b.MOSAIC_SQL}, lim AS (SELECT min(v) AS lo, 0.4 * max(v) AS hi FROM mosaic)
  SELECT event_id, CAST(CASE WHEN v IS NULL THEN 128 WHEN lo = hi THEN 0 ELSE floor((least(greatest(v, lo), hi) - lo) / nullif(hi - lo, 0) * 255) END AS INTEGER) AS grey FROM mosaic, lim""")
def normalise_u8(spark, d):
    return raster.to_grey(b.mosaic(spark, d)).select("event_id", "grey")


@query(f"WITH {b.MOSAIC_SQL} SELECT min(v) AS low, CAST(0.41 AS DOUBLE) * max(v) AS high FROM mosaic")
def global_bounds(spark, d):
    return raster.bounds(b.mosaic(spark, d), share=pixels.PREDICT_SHARE)


@query(f"""WITH {b.MOSAIC_SQL}, r AS (SELECT y, ntile(10) OVER (ORDER BY y) - 1 AS part FROM (SELECT DISTINCT y FROM mosaic)), c AS (SELECT x, ntile(10) OVER (ORDER BY x) - 1 AS part FROM (SELECT DISTINCT x FROM mosaic)),
  k AS (SELECT r.part * 10 + c.part AS chunk, CASE WHEN v > 250 THEN v END AS v FROM mosaic m JOIN r ON m.y = r.y JOIN c ON m.x = c.x),
  n AS (SELECT chunk, count(v) AS n_valid, max(v) AS greatest FROM k GROUP BY chunk HAVING count(v) > 0)
  SELECT chunk, n_valid, greatest, row_number() OVER (ORDER BY chunk) - 1 AS ordinal FROM n""")
def valid_chunk_ordinal(spark, d):
    m = b.mosaic(spark, d).withColumn("chunk", grid.chunk_of(F.col("y"), F.col("x"), F.col("h"), F.col("w"), 100))
    return raster.valid_chunks(m.withColumn("v", pixels.unless(~(F.col("v") > 250), F.col("v"))))


# --- spatial masks


@query(f"WITH {b.MOSAIC_SQL} SELECT event_id, y, x, v FROM mosaic WHERE class NOT IN (20, 21)")
def landcover_mask(spark, d):
    m = b.mosaic(spark, d)
    return spatial.without_classes(m, m.select("y", "x", "class"), pixels.URBAN_CLASSES).select("event_id", "y", "x", "v")


_POINTS = "pts AS (SELECT s_suppkey * 37 % w + 0.5 AS px, s_suppkey * 53 % w + 0.25 AS py FROM supplier, side)"
# A pixel is where its centre is; until the third round these compared its corner.
_NEAR = "(m.x + 0.5 - px) * (m.x + 0.5 - px) + (m.y + 0.5 - py) * (m.y + 0.5 - py)"
_INSIDE = "m.x + 0.5 > x0 AND m.x + 0.5 <= x1 AND m.y + 0.5 >= y0 AND m.y + 0.5 < y1"


@query(f"WITH {b.MOSAIC_SQL}, {_POINTS} SELECT event_id, y, x FROM mosaic m WHERE NOT EXISTS (SELECT 1 FROM pts WHERE {_NEAR} <= 4.0)")
def buffer_mask(spark, d):
    return spatial.outside_buffer(b.mosaic(spark, d), rasterize.layer_of(b.points(spark, d), "Point"), 2.0, b.mosaic_grid(spark, d)).select("event_id", "y", "x")


_LAND = "land AS (SELECT s_suppkey * 41 % w - 0.5 AS x0, s_suppkey * 29 % w - 0.5 AS y0, s_suppkey * 41 % w + 3.5 + s_suppkey % 5 AS x1, s_suppkey * 29 % w + 2.5 + s_suppkey % 4 AS y1 FROM supplier, side)"


@query(f"WITH {b.MOSAIC_SQL}, {_LAND} SELECT event_id, y, x FROM mosaic m WHERE EXISTS (SELECT 1 FROM land WHERE {_INSIDE})")
def complement_mask(spark, d):
    return spatial.covered(b.mosaic(spark, d), rasterize.layer_of(b.land_boxes(spark, d), "Polygon"), b.mosaic_grid(spark, d)).select("event_id", "y", "x")


@query(f"""WITH {b.MOSAIC_SQL}, {_POINTS}, {_LAND} SELECT event_id, v FROM mosaic m WHERE class NOT IN (20, 21)
  AND EXISTS (SELECT 1 FROM land WHERE {_INSIDE}) AND NOT EXISTS (SELECT 1 FROM pts WHERE {_NEAR} <= 2.25)""")
def feature_masks(spark, d):
    m = b.mosaic(spark, d)
    layers = {"rivers": rasterize.layer_of(b.points(spark, d), "Point"), "land": rasterize.layer_of(b.land_boxes(spark, d), "Polygon"), "land_cover": m.select("y", "x", "class")}
    return spatial.mask_features(m, layers, b.mosaic_grid(spark, d), river_buffer=1.5).select("event_id", "v")


# Lakes: octagons with a square island, in metres on 10 m pixels of UTM zone 31; each vertex (k, x, y), ring 0 outer, 1 the hole.
_LAKES_SQL = """corners AS (SELECT * FROM (VALUES (0, 0, 41, 0), (0, 1, 29, 31), (0, 2, 0, 43), (0, 3, -33, 29), (0, 4, -43, 0), (0, 5, -27, -34), (0, 6, 0, -47), (0, 7, 36, -28), (1, 0, 13, 11), (1, 1, -12, 14), (1, 2, -13, -12), (1, 3, 11, -14)) AS t(ring, k, dx, dy)),
lakes AS (SELECT s_suppkey, ring, k, 500000.25 + s_suppkey * 613 % (w * 10) + dx AS px, 5900000.75 - s_suppkey * 977 % (w * 10) + dy AS py FROM supplier, side, corners),
ends AS (SELECT l.s_suppkey, l.px AS ax, l.py AS ay, n.px AS ex, n.py AS ey FROM lakes l JOIN lakes n ON l.s_suppkey = n.s_suppkey AND l.ring = n.ring AND n.k = (l.k + 1) % CASE WHEN l.ring = 0 THEN 8 ELSE 4 END),
centres AS (SELECT event_id, y, x, 500000 + (x + 0.5) * 10 AS cx, 5900000 - (y + 0.5) * 10 AS cy FROM mosaic),
crossed AS (SELECT event_id, s_suppkey FROM centres JOIN ends ON (ay > cy) <> (ey > cy) AND cx <= ax + (cy - ay) * (ex - ax) / nullif(ey - ay, 0)),
inside AS (SELECT DISTINCT event_id FROM (SELECT event_id, s_suppkey, count(*) AS n FROM crossed GROUP BY event_id, s_suppkey) WHERE n % 2 = 1)"""


def _lakes(spark, d):
    outer = [(41, 0), (29, 31), (0, 43), (-33, 29), (-43, 0), (-27, -34), (0, -47), (36, -28)]
    hole = [(13, 11), (-12, 14), (-13, -12), (11, -14)]
    s = b.table(spark, d, "supplier").crossJoin(F.broadcast(b.mosaic_side(spark, d)))
    x, y = 500000.25 + F.col("s_suppkey") * 613 % (F.col("w") * 10), 5900000.75 - F.col("s_suppkey") * 977 % (F.col("w") * 10)
    ring = lambda corners: F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners))
    return s.select("s_suppkey", F.lit("Polygon").alias("kind"), F.array(ring(outer), ring(hole)).alias("rings"))


def _utm(spark, d):
    return b.mosaic_grid(spark, d, 10.0, 500000.0, 5900000.0, "EPSG:32631")


@query(f"WITH {b.MOSAIC_SQL}, {_LAKES_SQL} SELECT event_id, y, x FROM mosaic WHERE event_id IN (SELECT event_id FROM inside)")
def polygons_with_holes(spark, d):
    """Pixels whose centres are in lakes but not on their islands."""
    return spatial.covered(b.mosaic(spark, d), _lakes(spark, d), _utm(spark, d)).select("event_id", "y", "x")


_DISTANCE2 = """(cx - ax - t * (ex - ax)) * (cx - ax - t * (ex - ax)) + (cy - ay - t * (ey - ay)) * (cy - ay - t * (ey - ay))"""


@query(f"""WITH {b.MOSAIC_SQL}, {_LAKES_SQL},
  near AS (SELECT event_id, ax, ay, ex, ey, cx, cy, least(greatest(((cx - ax) * (ex - ax) + (cy - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0), 1) AS t
    FROM centres JOIN ends ON cx BETWEEN least(ax, ex) - 20 AND greatest(ax, ex) + 20 AND cy BETWEEN least(ay, ey) - 20 AND greatest(ay, ey) + 20)
  SELECT event_id, y, x FROM mosaic WHERE event_id NOT IN (SELECT event_id FROM inside) AND event_id NOT IN (SELECT event_id FROM near WHERE {_DISTANCE2} <= 400)""")
def buffer_in_metres(spark, d):
    """Pixels farther than 20 m from every lake; a buffer also reaches into islands."""
    return spatial.outside_buffer(b.mosaic(spark, d), _lakes(spark, d), 20.0, _utm(spark, d)).select("event_id", "y", "x")


@query(f"WITH {b.MOSAIC_SQL}, {_LAKES_SQL} SELECT event_id, y, x FROM mosaic WHERE event_id IN (SELECT event_id FROM inside)")
def reprojected_layer(spark, d):
    """The lakes given in degrees mask the same pixels as in UTM."""
    degrees = _lakes(spark, d).withColumn("rings", F.transform("rings", lambda r: crs.points(r, "EPSG:32631", "EPSG:4326")))
    return spatial.covered(b.mosaic(spark, d), degrees, _utm(spark, d), source="EPSG:4326").select("event_id", "y", "x")


_KRUEGER_SQL = """par AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n, 6378137.0 AS a),
ser AS (SELECT n, 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS r, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280] AS al FROM par),
geo AS (SELECT c_custkey, (c_custkey * 37 % 6000) / 1000.0 AS lon, (c_custkey * 53 % 70000) / 1000.0 AS lat FROM customer),
sph AS (SELECT c_custkey, r, al, radians(lon - 3) AS l, sinh(atanh(sin(radians(lat))) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(radians(lat)))) AS t FROM geo, ser),
unit AS (SELECT c_custkey, r, al, atan2(t, cos(l)) AS p, atanh(sin(l) / sqrt(1 + t * t)) AS q FROM sph)"""


@query(f"""WITH {_KRUEGER_SQL} SELECT c_custkey, round(500000 + r * (q + list_sum(list_transform([1, 2, 3, 4], lambda j: al[j] * cos(2 * j * p) * sinh(2 * j * q)))), 3) AS easting,
  round(r * (p + list_sum(list_transform([1, 2, 3, 4], lambda j: al[j] * sin(2 * j * p) * cosh(2 * j * q)))), 3) AS northing, true AS back FROM unit""")
def utm_coordinates(spark, d):
    """Degrees to UTM zone 31 in millimetres; back: the inverse gives the degrees again, to a tenth of a millimetre."""
    k = F.col("c_custkey")
    geo = b.table(spark, d, "customer").select("c_custkey", (k * 37 % 6000 / 1000.0).alias("lon"), (k * 53 % 70000 / 1000.0).alias("lat"))
    placed = geo.withColumn("p", crs.point(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32631"))
    again = placed.withColumn("q", crs.point(F.col("p.x"), F.col("p.y"), "EPSG:32631", "EPSG:4326"))
    return again.select("c_custkey", F.round("p.x", 3).alias("easting"), F.round("p.y", 3).alias("northing"), ((F.abs(F.col("q.x") - F.col("lon")) < 1e-9) & (F.abs(F.col("q.y") - F.col("lat")) < 1e-9)).alias("back"))


@query(f"""WITH {b.MOSAIC_SQL}, cover AS (SELECT y, x, class FROM mosaic)
  SELECT m.event_id, c.class FROM mosaic m LEFT JOIN cover c ON c.y = floor((m.y * 10 + 5 + 37) / 100) AND c.x = floor((m.x * 10 + 5 + 61) / 100) WHERE c.class IS NULL OR c.class NOT IN (20, 21)""")
def nearest_land_cover(spark, d):
    """Land cover of 100 m cells, whose grid begins 61 m west and 37 m north of the raster's, on pixels of 10 m."""
    m, grid_of = b.mosaic(spark, d), _utm(spark, d)
    cover = rasterize.Grid(grid_of.height, grid_of.width, 100.0, grid_of.c - 61, -100.0, grid_of.f + 37, grid_of.crs)
    kept = rasterize.without_cover(m.select("event_id", "y", "x"), m.select("y", "x", "class"), pixels.URBAN_CLASSES, grid_of, cover)
    placed, land = rasterize.nearest_class(kept, grid_of, cover), m.select(F.col("y").alias("cover_y"), F.col("x").alias("cover_x"), "class")
    return placed.join(land, ["cover_y", "cover_x"], "left").select("event_id", "class")


# --- label files


@query(f"WITH {b.LINES_SQL} SELECT file, line_no, value FROM cleaned")
def clean_label_rows(spark, d):
    return labels.clean(b.label_lines(spark, d))


@query(f"""WITH {b.LINES_SQL}, n AS (SELECT file, line_no, chunk, lead(chunk) OVER (PARTITION BY file ORDER BY line_no) AS next_chunk FROM parsed)
  SELECT file, line_no, chunk, next_chunk FROM n WHERE next_chunk - chunk <> 1""")
def sequence_gaps(spark, d):
    return labels.gaps(labels.clean(b.label_lines(spark, d)))


@query(f"WITH {b.LINES_SQL} SELECT file, arg_max(chunk, line_no) + 1 AS resume_at FROM parsed GROUP BY file")
def resume_chunk(spark, d):
    return labels.last_chunk(labels.clean(b.label_lines(spark, d)))


@query(f"""WITH {b.LINES_SQL}, n AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS row, nr <> 0 AND NOT has_r AS res_missing, nr = 0 AND has_r AS res_extra, nb <> 0 AND NOT has_b AS body_missing, nb = 0 AND has_b AS body_extra FROM parsed)
  SELECT * FROM n WHERE res_missing OR res_extra OR body_missing OR body_extra""")
def incomplete_labels(spark, d):
    return labels.incomplete(labels.clean(b.label_lines(spark, d)))


BOXES_SQL = f"""WITH {b.LINES_SQL}, s AS (SELECT *, nb > 0 AND coalesce(f[9] = '[  0.   0. 157. 157.]', false) AS sea FROM parsed),
  kinds AS (SELECT file, line_no, chunk, 'reservoirs' AS class, i AS k, f[4 + i] AS cell FROM s, unnest(range(5)) AS t(i) WHERE i < nr
    UNION ALL SELECT file, line_no, chunk, 'water-bodies', i, f[9 + i] FROM s, unnest(range(20)) AS t(i) WHERE i < nb AND NOT sea AND 9 + i <= len(f)
    UNION ALL SELECT file, line_no, chunk, 'sea', 0, '[50.0 50.0 55.0 55.0]' FROM s WHERE sea UNION ALL SELECT file, line_no, chunk, 'land', 0, '[50.0 50.0 55.0 55.0]' FROM s WHERE nr = 0 AND nb = 0),
  n AS (SELECT file, line_no, chunk, class, k, list_transform(regexp_split_to_array(trim(regexp_replace(cell, '[\\[\\]]', '', 'g')), '\\s+'), lambda v: TRY_CAST(v AS DOUBLE)) AS c FROM kinds),
  o AS (SELECT *, len(c) = 4 AND c[1] < c[3] AND c[2] < c[4] AS ok, least(greatest((c[1] + c[3]) / 2 - 15.7, 0.0), 125.6) AS x, least(greatest((c[2] + c[4]) / 2 - 15.7, 0.0), 125.6) AS y FROM n)"""


@query(BOXES_SQL + """ SELECT file, line_no, chunk, class, CAST(k AS INTEGER) AS k, CASE WHEN ok THEN round(x, 6) END AS ulx, CASE WHEN ok THEN round(y, 6) END AS uly FROM o""")
def explode_label_boxes(spark, d):
    got = labels.boxes(labels.clean(b.label_lines(spark, d)))
    return got.select("file", "line_no", "chunk", "class", "k", F.round("box.ulx", 6).alias("ulx"), F.round("box.uly", 6).alias("uly"))


@query(f"""WITH {b.LINES_SQL} SELECT file, line_no, CASE WHEN line_no > 0 AND line_no % 10 = 0 THEN CAST(line_no - 1 AS VARCHAR) || ',0,0,,,,,,' ELSE value END AS value FROM lines""")
def correct_labels(spark, d):
    lines = b.label_lines(spark, d)
    fixes = lines.where("line_no > 0 and line_no % 10 = 0").select("file", "line_no", F.concat((F.col("line_no") - 1).cast("string"), F.lit(",0,0,,,,,,")).alias("value"))
    return labels.correct(lines, fixes)


@query(f"WITH {b.LINES_SQL}, m AS (SELECT file, max(line_no) AS last FROM lines GROUP BY file) SELECT l.file, l.line_no, l.value FROM lines l JOIN m ON l.file = m.file WHERE greatest(m.last - 25, 0) >= l.line_no")
def undo_labels(spark, d):
    return labels.undo(b.label_lines(spark, d), 25)


@query("""WITH s AS (SELECT c_custkey, list_sort(list_distinct([c_custkey % 7, c_custkey % 3, c_nationkey % 5, 2])) AS u FROM customer) SELECT c_custkey, array_to_string(u, ',') AS rows FROM s""")
def unique_sorted_rows(spark, d):
    k = F.col("c_custkey")
    arrays = F.array(F.array(k % 7, k % 3), F.array((F.col("c_nationkey") % 5).cast("bigint"), F.lit(2).cast("bigint")))
    return b.table(spark, d, "customer").select("c_custkey", labels.to_line(labels.unique_sorted(arrays).cast("array<string>")).alias("rows"))


@query(BOXES_SQL + """, q AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, class ORDER BY line_no, k) - 1 AS BIGINT) AS idx FROM o WHERE ok)
  SELECT file, class, idx, 'T' || file || '-20250331-' || CASE WHEN idx < 10000 THEN lpad(CAST(idx AS VARCHAR), 4, '0') ELSE CAST(idx AS VARCHAR) END || '.png' AS name FROM q""")
def patch_names(spark, d):
    from pyspark.sql import Window

    rows = labels.boxes(labels.clean(b.label_lines(spark, d))).where("box is not null")
    order = Window.partitionBy("file", "class").orderBy("line_no", "k")
    rows = rows.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))
    date = names.sensing_date(F.lit("20250331T110651"))
    return labels.named_patches(rows, F.concat(F.lit("T"), F.col("file").cast("string")), date).select("file", "class", "idx", "name")


# --- scenes and names


@query(f"""WITH {b.SCENES_SQL} SELECT o_orderkey, f[1] AS satellite, f[6] AS tile, f[6] || '_' || f[3] AS prefix, split_part(f[3], 'T', 1) AS day, strptime(f[3], '%Y%m%dT%H%M%S') AS sensed_at,
  f[6] || '_' || f[3] || '_B08_10m.jp2' AS band_file FROM named WHERE len(f) = 7""")
def scene_name_fields(spark, d):
    rows = b.scene_names(spark, d).withColumn("f", names.scene_fields(F.col("scene"))).where("f is not null")
    f = F.col("f")
    prefix = names.scene_prefix(f)
    return rows.select("o_orderkey", f["satellite"].alias("satellite"), f["tile"].alias("tile"), prefix.alias("prefix"), names.sensing_date(f["sensing_time"]).alias("day"), names.sensed_at(f).alias("sensed_at"),
                       names.band_file(prefix, F.lit(names.index_bands(True)["nir"]), F.lit("10m")).alias("band_file"))


@query(f"WITH {b.SCENES_SQL} SELECT substr(f[3], 1, 4) AS year, f[1] AS satellite, f[6] AS tile, substr(f[3], 5, 2) AS month, count(*) AS n FROM named WHERE len(f) = 7 GROUP BY ALL")
def scene_summary(spark, d):
    return scenes.summary(b.scene_names(spark, d))


@query(f"WITH {b.SCENES_SQL} SELECT count(DISTINCT f[6]) AS tiles, count(DISTINCT f[6]) = 1 AS single FROM named WHERE len(f) = 7")
def tile_check(spark, d):
    return scenes.one_tile(b.scene_names(spark, d))


@query(f"WITH {b.SCENES_SQL} SELECT min(scene) AS scene FROM named WHERE len(f) = 7")
def default_scene(spark, d):
    return scenes.default_scene(b.scene_names(spark, d))


@query(f"WITH {b.SCENES_SQL} SELECT DISTINCT scene FROM named ORDER BY scene LIMIT 10")
def first_scenes(spark, d):
    """A chosen number of images: the limit is the feature."""
    return scenes.first_scenes(b.scene_names(spark, d), 10)


_FILES_SQL = "files AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'other ' || event_id || '.png' ELSE 'ndwi chunk ' || event_id // 25 || ' minichunk  ' || event_id % 25 || '.png' END AS name FROM events)"


@query(f"""WITH {_FILES_SQL} SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(name, 'chunk\\s+(\\d+)\\s+minichunk\\s+(\\d+)', 1), '') AS INTEGER), -1) AS chunk,
  coalesce(TRY_CAST(nullif(regexp_extract(name, 'chunk\\s+(\\d+)\\s+minichunk\\s+(\\d+)', 2), '') AS INTEGER), -1) AS minichunk FROM files""")
def filename_keys(spark, d):
    i = F.col("event_id")
    name = F.when(i % 9 == 0, F.concat(F.lit("other "), i.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("ndwi chunk "), F.floor(i / 25).cast("string"), F.lit(" minichunk  "), (i % 25).cast("string"), F.lit(".png")))
    return b.table(spark, d, "events").select("event_id", names.chunk_key(name).alias("k")).select("event_id", "k.*")


@query("""SELECT event_id, CAST(floor(value * 50) AS BIGINT) // 3600 AS hours, CAST(floor(value * 50) AS BIGINT) % 3600 // 60 AS minutes, CAST(floor(value * 50) AS BIGINT) % 60 AS seconds FROM events""")
def hms(spark, d):
    return b.table(spark, d, "events").select("event_id", names.hms(F.col("value") * 50).alias("t")).select("event_id", "t.*")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE contains(c_name, CAST(s_suppkey % 10 AS VARCHAR) || CAST(s_nationkey AS VARCHAR)))")
def duplicate_names(spark, d):
    """Names that contain one of a short list of names: the list is the distinct last parts, at most 250."""
    parts = b.table(spark, d, "supplier").select(F.concat((F.col("s_suppkey") % 10).cast("string"), F.col("s_nationkey").cast("string")).alias("part")).distinct()
    return images.containing(b.table(spark, d, "customer"), parts, "c_name", "part").select("c_custkey", "c_name")


@query(f"""WITH {_FILES_SQL}, k AS (SELECT f.event_id, f.name, e.user_id % 50 AS scene, TRY_CAST(nullif(regexp_extract(name, 'chunk\\s+(\\d+)\\s+minichunk\\s+(\\d+)', 1), '') AS INTEGER) AS c,
  TRY_CAST(nullif(regexp_extract(name, 'chunk\\s+(\\d+)\\s+minichunk\\s+(\\d+)', 2), '') AS INTEGER) AS m FROM files f JOIN events e ON f.event_id = e.event_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY c NULLS LAST, m NULLS LAST, name) - 1 AS place FROM k) SELECT event_id, scene, name FROM n WHERE place >= 2 AND place < 10""")
def ordered_slice(spark, d):
    """Eight files of each scene by their place in the order: the limits are the feature."""
    i = F.col("event_id")
    name = F.when(i % 9 == 0, F.concat(F.lit("other "), i.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("ndwi chunk "), F.floor(i / 25).cast("string"), F.lit(" minichunk  "), (i % 25).cast("string"), F.lit(".png")))
    return predictions.slice_in_order(b.table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("scene"), name.alias("name")), 2, 8)


# --- predictions and evaluation

_LOGITS_SQL = "logits AS (SELECT vec_id, list_transform(range(4), lambda j: list_sum(list_transform(range(16), lambda i: CAST(embedding[4 * i + j + 1] AS DOUBLE)))) AS z FROM embeddings)"


@query(f"""WITH {_LOGITS_SQL}, e AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS s FROM logits)
  SELECT vec_id, ['LAND', 'RESERVOIRS', 'SEA', 'WATER-BODIES'][list_position(z, list_max(z))] AS label, round(100 * list_max(s) / list_sum(s), 6) AS confidence FROM e""")
def predict_argmax(spark, d):
    """Four logits per vector: the sums of every fourth value."""
    rows = b.table(spark, d, "embeddings").select("vec_id", F.array(*(_every_fourth(j) for j in range(4))).alias("logits"))
    return rounded(predictions.decide(rows).select("vec_id", "label", "confidence"), "confidence")


def _every_fourth(j):
    values = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("embedding", 4 * i + j).cast("double"))
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


_CELLS = ", ".join(f"max(CASE WHEN minichunk = {m} THEN label || ' ' || CAST(CAST(confidence AS BIGINT) AS VARCHAR) || '.00' END) AS \"{m}\"" for m in range(25))


@query(f"WITH {b.PREDICTIONS_SQL} SELECT chunk, {_CELLS} FROM predictions GROUP BY chunk")
def prediction_pivot(spark, d):
    return predictions.wide(b.predictions(spark, d))


@query(f"WITH {b.PREDICTIONS_SQL} SELECT chunk, minichunk, label, confidence FROM predictions WHERE chunk >= 3 AND chunk < 23")
def chunk_range(spark, d):
    """A range of chunks: the limits are the feature."""
    return predictions.chunk_range(b.predictions(spark, d), 3, 20)


@query("""WITH r AS (SELECT user_id AS chunk, value AS confidence, event_id AS ord, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events)
  SELECT chunk, confidence, ord, label FROM r WHERE n = 1""")
def dedupe_max_confidence(spark, d):
    e = b.table(spark, d, "events").select(F.col("user_id").alias("chunk"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"))
    return predictions.best_per_chunk(e)


_TRUE_SQL = """truth AS (SELECT chunk, CASE WHEN chunk % 10 = 0 THEN 0 ELSE 25 - chunk % 6 - chunk % 4 END AS n_land, CASE WHEN chunk % 10 = 0 THEN 0 ELSE chunk % 6 END AS n_reservoirs,
  CASE WHEN chunk % 10 = 0 THEN 25 ELSE 0 END AS n_sea, CASE WHEN chunk % 10 = 0 THEN 0 ELSE chunk % 4 END AS n_water_bodies FROM (SELECT DISTINCT chunk FROM predictions))"""
_COUNTS_SQL = f"""WITH {b.PREDICTIONS_SQL}, p AS (SELECT chunk, count(*) FILTER (WHERE label = 'LAND' OR (label IN ('RESERVOIRS', 'WATER-BODIES') AND confidence < 40)) AS p_land, count(*) FILTER (WHERE label = 'RESERVOIRS' AND confidence >= 40) AS p_reservoirs,
  count(*) FILTER (WHERE label = 'SEA') AS p_sea, count(*) FILTER (WHERE label = 'WATER-BODIES' AND confidence >= 40) AS p_water_bodies FROM predictions GROUP BY chunk), {_TRUE_SQL},
  k AS (SELECT 'land' AS class, p_land AS p, n_land AS n FROM p JOIN truth USING (chunk) UNION ALL SELECT 'reservoirs', p_reservoirs, n_reservoirs FROM p JOIN truth USING (chunk)
    UNION ALL SELECT 'sea', p_sea, n_sea FROM p JOIN truth USING (chunk) UNION ALL SELECT 'water_bodies', p_water_bodies, n_water_bodies FROM p JOIN truth USING (chunk)),
  c AS (SELECT class, CAST(sum(least(p, n)) AS BIGINT) AS tp, CAST(sum(25 - greatest(p, n)) AS BIGINT) AS tn, CAST(sum(greatest(p - n, 0)) AS BIGINT) AS fp, CAST(sum(greatest(n - p, 0)) AS BIGINT) AS fn, count(*) AS chunks FROM k GROUP BY class)"""


@query(f"""WITH {b.LINES_SQL} SELECT CAST(line_no - 1 AS INTEGER) AS chunk, nr AS reservoirs, nb AS water_bodies, nb = 1 AND coalesce(f[9] = '[  0.   0. 157. 157.]', false) AS sea FROM parsed""")
def label_responses(spark, d):
    return evaluation.responses(labels.clean(b.label_lines(spark, d)))


@query("""WITH h AS (SELECT l_returnflag AS run, l_orderkey * 10 + l_linenumber AS epoch, l_extendedprice AS loss FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS low, row_number() OVER (PARTITION BY run ORDER BY loss DESC, epoch) AS high FROM h)
  SELECT run, max(CASE WHEN low = 1 THEN loss END) AS least, max(CASE WHEN low = 1 THEN epoch END) AS least_epoch, max(CASE WHEN high = 1 THEN loss END) AS greatest, max(CASE WHEN high = 1 THEN epoch END) AS greatest_epoch FROM r GROUP BY run""")
def history_extrema(spark, d):
    h = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("epoch"), F.col("l_extendedprice").alias("loss"))
    return evaluation.extrema(h, "loss", by=("run",))


def _cells_and_truth(spark, d):
    p = b.predictions(spark, d)
    cells = p.select("chunk", F.concat_ws(" ", "label", F.col("confidence").cast("string")).alias("cell"))
    truth = p.select("chunk").distinct().select("chunk", (F.col("chunk") % 6).alias("reservoirs"), (F.col("chunk") % 4).alias("water_bodies"), (F.col("chunk") % 10 == 0).alias("sea"))
    return cells, evaluation.true_counts(truth)


def _confusion(spark, d):
    cells, truth = _cells_and_truth(spark, d)
    return evaluation.confusion(evaluation.predicted_counts(cells, 40.0), truth)


@query(_COUNTS_SQL + " SELECT * FROM c")
def confusion_counts(spark, d):
    return _confusion(spark, d)


_THRESHOLDS = (0.0, 10.0, 25.0, 33.0, 40.0, 50.0, 62.5, 75.0, 90.0, 99.0, 100.0, 101.0)


@query(f"""WITH {b.PREDICTIONS_SQL}, steps AS (SELECT unnest([{', '.join(map(str, _THRESHOLDS))}])::DOUBLE AS threshold),
  sure AS (SELECT threshold, chunk, CASE WHEN label IN ('RESERVOIRS', 'WATER-BODIES') AND confidence < threshold THEN 'LAND' ELSE label END AS label FROM predictions, steps),
  p AS (SELECT threshold, chunk, count(*) FILTER (label = 'LAND') AS land, count(*) FILTER (label = 'RESERVOIRS') AS reservoirs, count(*) FILTER (label = 'SEA') AS sea, count(*) FILTER (label = 'WATER-BODIES') AS water_bodies FROM sure GROUP BY threshold, chunk),
  k AS (SELECT threshold, 'land' AS class, land AS p, CASE WHEN chunk % 10 = 0 THEN 0 ELSE 25 - chunk % 6 - chunk % 4 END AS n FROM p UNION ALL SELECT threshold, 'reservoirs', reservoirs, CASE WHEN chunk % 10 = 0 THEN 0 ELSE chunk % 6 END FROM p
    UNION ALL SELECT threshold, 'sea', sea, CASE WHEN chunk % 10 = 0 THEN 25 ELSE 0 END FROM p UNION ALL SELECT threshold, 'water_bodies', water_bodies, CASE WHEN chunk % 10 = 0 THEN 0 ELSE chunk % 4 END FROM p)
  SELECT threshold, class, CAST(sum(least(p, n)) AS BIGINT) AS tp, CAST(sum(25 - greatest(p, n)) AS BIGINT) AS tn, CAST(sum(greatest(p - n, 0)) AS BIGINT) AS fp, CAST(sum(greatest(n - p, 0)) AS BIGINT) AS fn, count(*) AS chunks FROM k GROUP BY threshold, class""")
def confusion_by_threshold(spark, d):
    """The confusion counts of all thresholds at once."""
    cells, truth = _cells_and_truth(spark, d)
    return evaluation.confusion_by_threshold(cells, truth, list(_THRESHOLDS))


@query(_COUNTS_SQL + """, m AS (SELECT *, round(coalesce(100.0 * (tp + tn) / nullif(chunks * 25, 0), 100), 2) AS acc, round(coalesce(CAST(100 AS DOUBLE) * tp / nullif(tp + fp, 0), 100), 2) AS prec,
  round(coalesce(CAST(100 AS DOUBLE) * tp / nullif(tp + fn, 0), 100), 2) AS recall, round(coalesce(CAST(100 AS DOUBLE) * tn / nullif(tn + fp, 0), 100), 2) AS spec FROM c)
  SELECT class, CAST(acc AS DOUBLE) AS acc, prec, recall, spec, round(coalesce(2 * prec * recall / nullif(prec + recall, 0), 100), 2) AS f1 FROM m""")
def class_metrics(spark, d):
    return evaluation.metrics(_confusion(spark, d)).select("class", "acc", "prec", "recall", "spec", "f1")


@query(f"WITH {b.PREDICTIONS_SQL} SELECT label, count(*) AS n FROM predictions GROUP BY ROLLUP (label)")
def class_totals(spark, d):
    return evaluation.class_totals(b.predictions(spark, d), "label")


@query("SELECT l_linenumber AS epochs, round(avg(l_discount), 9) AS mean_accuracy, count(*) AS runs FROM lineitem GROUP BY l_linenumber")
def epoch_sweep(spark, d):
    runs = b.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("epochs"), F.col("l_discount").alias("accuracy"))
    return rounded(evaluation.mean_by_setting(runs), "mean_accuracy", digits=9)


# --- models


@query("SELECT vec_id, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':123'), 1, 8) AS BIGINT) % 1000 < 200 AS validation FROM embeddings")
def train_split(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", model.in_validation(F.col("vec_id")).alias("validation"))


@query()
def mlp_predict(spark, d):
    """Rows only: the optimiser isn't SQL."""
    rows = b.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("px"), "label")
    fit, _ = model.split(rows, "vec_id")
    got = model.predict_perceptron(model.fit_perceptron(fit, steps=20), rows)
    return got.select("vec_id", "predicted", F.round("confidence", 3).alias("confidence"))


@query()
def cnn_predict(spark, d):
    """Rows only: the network, trained for an epoch on the training part of the 8 x 8 rasters, and its forward pass over all."""
    rows = b.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor((v + 1) * 127).cast("smallint")).alias("px"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    labelled = model.resize(rows.join(b.table(spark, d, "embeddings").select("vec_id", (F.col("label") % len(CLASS_NAMES)).alias("label")), "vec_id"), 31)
    weights = model.fit_convolution(model.split(labelled, "vec_id")[0], len(CLASS_NAMES), key="vec_id", epochs=1, workers=8)
    got = predictions.decide(model.predict_convolution(rows, weights))
    return got.select("vec_id", "label", F.round("confidence", 6).alias("confidence"))
