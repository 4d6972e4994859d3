"""The driver's tables in the roles of scenes, rasters, label files, features and predictions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.config import CLASS_NAMES
from mereling.functions import pixels
from mereling.operators.rasterize import Grid

LINES_PER_FILE = 5000
LANGUAGES = ("en", "fr", "de", "es")  # in the order of CLASS_NAMES
CLOUD_DN = 1250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as 8 x 8 rasters: scene, tile, y, x, green, nir (digital numbers)."""
    e = table(spark, sf_dir, "embeddings")
    dn = lambda v: F.floor((v.cast("double") + 1) * 1000).cast("int")
    cells = e.select(F.col("vec_id").alias("scene"), F.col("label").alias("tile"), "embedding", F.posexplode("embedding").alias("p", "v"))
    return cells.select("scene", "tile", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), dn(F.col("v")).alias("green"), dn(F.get("embedding", 63 - F.col("p"))).alias("nir"))


def scenes_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud classes of bright pixels: scene, y, x, cls (4 isn't masked)."""
    p = scenes_pixels(spark, sf_dir).where(F.col("green") > CLOUD_DN)
    return p.select("scene", "y", "x", (1 + (F.col("y") * 8 + F.col("x")) % 4).alias("cls"))


def masked_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDWI with bright pixels hidden, on the fly: scene, tile, y, x, v."""
    p = scenes_pixels(spark, sf_dir)
    return p.select("scene", "tile", "y", "x", pixels.unless(F.col("green") > CLOUD_DN, pixels.ndwi(F.col("green"), F.col("nir"))).alias("v"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as one raster of h rows of w pixels, the last row partly empty: event_id, y, x, h, w, v (null where the type is error), type, class."""
    e = table(spark, sf_dir, "events")
    rows = e.crossJoin(F.broadcast(mosaic_side(spark, sf_dir)))  # one row
    return rows.select(
        "event_id", F.floor(F.col("event_id") / F.col("w")).cast("bigint").alias("y"), (F.col("event_id") % F.col("w")).alias("x"), "h", "w",
        pixels.unless(F.col("event_type") == "error", F.col("value")).alias("v"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("class"))


MOSAIC_SQL = """side AS (SELECT CAST(ceil(sqrt(max(event_id) + 1)) AS BIGINT) AS w FROM events),
mosaic AS (SELECT event_id, event_id // w AS y, event_id % w AS x, w, CASE WHEN event_type <> 'error' THEN value END AS v, event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS class FROM events, side)"""
PIXELS_SQL = f"""pixels AS (SELECT vec_id AS scene, label AS tile, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
  CAST(floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 1000) AS INTEGER) AS green, CAST(floor((CAST(embedding[64 - p] AS DOUBLE) + 1) * 1000) AS INTEGER) AS nir
  FROM embeddings, unnest(range(64)) AS t(p)),
masked AS (SELECT scene, tile, y, x, CASE WHEN green <= {CLOUD_DN} THEN CAST(green - nir AS DOUBLE) / nullif(green + nir, 0) END AS v FROM pixels)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`supplier` as point features in the mosaic: s_suppkey, vertices (one)."""
    s = table(spark, sf_dir, "supplier")
    w = mosaic_side(spark, sf_dir)
    xy = F.struct(((F.col("s_suppkey") * 37 % F.col("w")) + 0.5).cast("double").alias("x"), ((F.col("s_suppkey") * 53 % F.col("w")) + 0.25).cast("double").alias("y"))
    return s.crossJoin(F.broadcast(w)).select("s_suppkey", F.array(xy).alias("vertices"))


def mosaic_grid(spark: SparkSession, sf_dir: str, side: float = 1.0, west: float = 0.0, north: float = 0.0, crs: str = "EPSG:4326") -> Grid:
    """The mosaic's grid, of pixels of `side` map units; rows run south where the side isn't 1."""
    h, w = mosaic_side(spark, sf_dir).first()
    return Grid(h, w, side, west, side if side == 1 else -side, north, crs)


def mosaic_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the mosaic's rows h and columns w, the least square that holds all ids."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id").alias("last"), F.ceil(F.sqrt(F.max("event_id") + 1)).cast("bigint").alias("w"))
    return last.select((F.floor(F.col("last") / F.col("w")) + 1).cast("bigint").alias("h"), "w")


def land_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`supplier` as rectangles: s_suppkey, x0, y0, x1, y1 and vertices."""
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(mosaic_side(spark, sf_dir)))
    x0, y0 = (F.col("s_suppkey") * 41 % F.col("w") - 0.5), (F.col("s_suppkey") * 29 % F.col("w") - 0.5)
    rows = s.select("s_suppkey", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 4 + F.col("s_suppkey") % 5).cast("double").alias("x1"), (y0 + 3 + F.col("s_suppkey") % 4).cast("double").alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rows.withColumn("vertices", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as label files of 5,000 lines: file, line_no, value; some blank, malformed, out of order or incomplete."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % LINES_PER_FILE
    c = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    chunk = n - 1 + F.when(k % 97 == 0, 5).otherwise(0)
    x, y = k % 120, k * 7 % 120
    box = c("[ ", x, ". ", y, ". ", x + 20, ". ", y + 30, ".]")
    other = c("[ ", y, ". ", x, ". ", y + 10, ". ", x + 15, ".]")
    value = (F.when(n == 0, "chunk,reservoirs,water-bodies,reservoir-coordinates,,,,,water-body-coordinates")
             .when(k % 17 == 3, "").when(k % 23 == 4, "note,0,0")
             .when(k % 29 == 5, c(chunk, ",1,0,,,,,,")).when(k % 31 == 6, c(chunk, ",0,0,", box, ",,,,,"))
             .when(k % 11 == 7, c(chunk, ",0,1,,,,,,[  0.   0. 157. 157.]"))
             .when(k % 13 == 8, c(chunk, ",1,1,", box, ",,,,,", other))
             .when(k % 7 == 1, c(chunk, ",2,0,", box, ",", other, ",,,,"))
             .when(k % 5 == 2, c(chunk, ",0,2,,,,,,", box, ",", other))
             .when(k % 37 == 9, c(chunk, ",1,0,[ a b c d],,,,,"))
             .otherwise(c(chunk, ",0,0,,,,,,")))
    return table(spark, sf_dir, "orders").select(F.floor(k / LINES_PER_FILE).cast("bigint").alias("file"), n.alias("line_no"), value.alias("value"))


LINES_SQL = f"""raw AS (SELECT o_orderkey AS k, o_orderkey // {LINES_PER_FILE} AS file, o_orderkey % {LINES_PER_FILE} AS n,
  o_orderkey % {LINES_PER_FILE} - 1 + CASE WHEN o_orderkey % 97 = 0 THEN 5 ELSE 0 END AS c, o_orderkey % 120 AS x, o_orderkey * 7 % 120 AS y FROM orders),
boxed AS (SELECT *, '[ ' || x || '. ' || y || '. ' || (x + 20) || '. ' || (y + 30) || '.]' AS b1, '[ ' || y || '. ' || x || '. ' || (y + 10) || '. ' || (x + 15) || '.]' AS b2 FROM raw),
lines AS (SELECT file, n AS line_no, CASE WHEN n = 0 THEN 'chunk,reservoirs,water-bodies,reservoir-coordinates,,,,,water-body-coordinates'
  WHEN k % 17 = 3 THEN '' WHEN k % 23 = 4 THEN 'note,0,0' WHEN k % 29 = 5 THEN c || ',1,0,,,,,,' WHEN k % 31 = 6 THEN c || ',0,0,' || b1 || ',,,,,'
  WHEN k % 11 = 7 THEN c || ',0,1,,,,,,[  0.   0. 157. 157.]' WHEN k % 13 = 8 THEN c || ',1,1,' || b1 || ',,,,,' || b2
  WHEN k % 7 = 1 THEN c || ',2,0,' || b1 || ',' || b2 || ',,,,' WHEN k % 5 = 2 THEN c || ',0,2,,,,,,' || b1 || ',' || b2
  WHEN k % 37 = 9 THEN c || ',1,0,[ a b c d],,,,,' ELSE c || ',0,0,,,,,,' END AS value FROM boxed),
cleaned AS (SELECT * FROM lines WHERE line_no < 2 OR regexp_matches(split_part(value, ',', 1), '^[0-9]+$') OR contains(split_part(value, ',', 1), 'chunk')),
parsed AS (SELECT file, line_no, TRY_CAST(f[1] AS INTEGER) AS chunk, coalesce(TRY_CAST(f[2] AS INTEGER), 0) AS nr, coalesce(TRY_CAST(f[3] AS INTEGER), 0) AS nb, f,
  coalesce(starts_with(f[4], '['), false) AS has_r, coalesce(starts_with(f[9], '['), false) AS has_b FROM (SELECT file, line_no, string_split(value, ',') AS f FROM cleaned WHERE line_no > 0))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as predictions of 25 mini-chunks a chunk: chunk, minichunk, label, confidence."""
    d = table(spark, sf_dir, "documents")
    label = F.element_at(F.array(*(F.lit(c.upper()) for c in CLASS_NAMES)), F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")).cast("int"))
    return d.select(F.floor(F.col("doc_id") / 25).cast("int").alias("chunk"), (F.col("doc_id") % 25).cast("int").alias("minichunk"), label.alias("label"), (F.col("n_chars") % 101).cast("double").alias("confidence"))


PREDICTIONS_SQL = """predictions AS (SELECT CAST(doc_id // 25 AS INTEGER) AS chunk, CAST(doc_id % 25 AS INTEGER) AS minichunk,
  CASE lang WHEN 'en' THEN 'LAND' WHEN 'fr' THEN 'RESERVOIRS' WHEN 'de' THEN 'SEA' WHEN 'es' THEN 'WATER-BODIES' END AS label, CAST(n_chars % 101 AS DOUBLE) AS confidence FROM documents)"""


def scene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as scene names: o_orderkey, scene."""
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 3, "0")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(
        F.when(k % 2 == 0, "S2A").otherwise("S2B"), F.lit("_MSIL2A_"), day, F.lit("T110651_N0511_R"), two(F.col("o_custkey") % 143), F.lit("_T"), two(k % 7), F.lit("UCU_"), day, F.lit("T143812"),
        F.when(k % 50 == 1, "_X").otherwise(""), F.lit(".SAFE"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("scene"))


SCENES_SQL = """scenes AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'S2A' ELSE 'S2B' END || '_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || 'T110651_N0511_R' || lpad(CAST(o_custkey % 143 AS VARCHAR), 3, '0')
  || '_T' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 3, '0') || 'UCU_' || strftime(o_orderdate, '%Y%m%d') || 'T143812' || CASE WHEN o_orderkey % 50 = 1 THEN '_X' ELSE '' END || '.SAFE' AS scene FROM orders),
named AS (SELECT o_orderkey, scene, string_split(regexp_replace(scene, '\\.SAFE$', ''), '_') AS f FROM scenes)"""
