"""Vector features: GeoJSON files as rows of rings, with the coordinate system they name, within a bounding box."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.operators import rasterize, spatial

_POINT = "array<double>"


def _parts(kind: Column, coordinates: Column) -> Column:
    """The parts of a geometry, each an array of rings: one for points and lines, a polygon's outer ring and its holes."""
    read = lambda depth: F.from_json(coordinates, "array<" * (depth - 1) + _POINT + ">" * (depth - 1))
    alone = lambda lines: F.transform(lines, lambda line: F.array(line))
    return (F.when(kind == "Point", alone(F.array(F.array(read(1))))).when(kind == "MultiPoint", alone(F.transform(read(2), lambda p: F.array(p))))
            .when(kind == "LineString", alone(F.array(read(2)))).when(kind == "MultiLineString", alone(read(3)))
            .when(kind == "Polygon", F.array(read(3))).when(kind == "MultiPolygon", read(4)))


def read_geojson(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, strict: bool = False) -> DataFrame:
    """(file, feature, kind, properties as JSON, crs, rings, vertices) of all features at `path`, a row per part of a multi-geometry.

    crs: the EPSG code that the file names, or EPSG:4326. rings: a polygon's outer ring and its holes, each without its
    repeated last vertex; of lines and points one. vertices: the first ring. bbox (left, bottom, right, top, in the file's
    system): only parts that meet it, or with `strict` lie in it. Features without a geometry give nothing. A
    file is read by one task; a large layer belongs in several files, or in a table of these rows.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.crs.properties.name").alias("name"), F.from_json("value", "features array<string>")["features"].alias("features"))
    named = F.when(F.col("name").isNull() | F.upper("name").contains("CRS84"), "EPSG:4326").otherwise(F.concat(F.lit("EPSG:"), F.regexp_extract("name", r"(\d+)\s*$", 1)))
    each = whole.select("file", named.alias("crs"), F.posexplode("features").alias("feature", "json"))
    kind = F.get_json_object("json", "$.geometry.type")
    parts = each.select("file", "feature", kind.alias("kind"), F.get_json_object("json", "$.properties").alias("properties"), "crs", F.explode(_parts(kind, F.get_json_object("json", "$.geometry.coordinates"))).alias("lines"))
    points = lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    opened = lambda line: F.when(F.col("kind").endswith("Polygon") & (F.size(line) > 1), F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))).otherwise(line)
    rows = parts.withColumn("rings", F.filter(F.transform("lines", lambda line: points(opened(line))), lambda r: F.size(r) > 0)).drop("lines")
    rows = rows.where(F.size("rings") > 0).withColumn("vertices", F.col("rings")[0])
    return rows if bbox is None else spatial.in_bounds(rows, *bbox, strict=strict)


#: Bits of a coordinate on the Hilbert curve.
ORDER = 16


def hilbert(x: Column, y: Column, order: int = ORDER) -> Column:
    """The place of a cell on the Hilbert curve through a square of 2 ** order cells a side."""
    last = (1 << order) - 1
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(at: Column, bit: Column) -> Column:
        right, low = at["x"].bitwiseAND(bit) > 0, at["y"].bitwiseAND(bit) == 0
        d = at["d"] + bit * bit * F.when(right, F.when(low, 3).otherwise(2)).otherwise(F.when(low, 0).otherwise(1))
        turned = lambda own, other: F.when(~low, own).when(right, F.lit(last) - other).otherwise(other)
        return F.struct(turned(at["x"], at["y"]).cast("bigint").alias("x"), turned(at["y"], at["x"]).cast("bigint").alias("y"), d.cast("bigint").alias("d"))

    return F.aggregate(F.array(*(F.lit(1 << b).cast("bigint") for b in reversed(range(order)))), start, step)["d"]


def write_store(layer: DataFrame, path: str, files: int = 64, group_bytes: int = 1 << 20) -> None:
    """A layer (kind, rings, ...) as Parquet in the order of the Hilbert curve, with each part's extent in columns.

    Parts that are near lie near in the files, so the extents' least and greatest values of files and row
    groups are tight and a box reads few of them. The curve spans the layer's own extent (one aggregate row);
    parts are dealt by ranges of their place on it, and many at one place only make that range longer.
    """
    boxed = layer.where(F.size(F.flatten("rings")) > 0).withColumn("_box", rasterize.extent(F.col("rings")))
    own = {n: F.col(f"_box.{b}") for n, b in (("min_x", "left"), ("min_y", "bottom"), ("max_x", "right"), ("max_y", "top"))}
    rows = boxed.withColumns(own).drop("_box")
    side = rows.agg(F.min("min_x").alias("x0"), F.min("min_y").alias("y0"), F.max("max_x").alias("x1"), F.max("max_y").alias("y1")).first()
    cell = lambda low, high, a, z: F.floor(((F.col(low) + F.col(high)) / 2 - (a or 0.0)) / max((z or 0.0) - (a or 0.0), 1e-12) * ((1 << ORDER) - 1))
    key = hilbert(cell("min_x", "max_x", side.x0, side.x1), cell("min_y", "max_y", side.y0, side.y1))
    placed = rows.withColumn("_h", key).repartitionByRange(files, "_h").sortWithinPartitions("_h").drop("_h")
    placed.write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Parts of a store whose extent meets a box (left, bottom, right, top, in the store's system); the comparisons reach the scan."""
    rows = spark.read.parquet(path)
    if bbox is None:
        return rows
    left, bottom, right, top = bbox
    return rows.where((F.col("max_x") >= left) & (F.col("min_x") <= right) & (F.col("max_y") >= bottom) & (F.col("min_y") <= top))
