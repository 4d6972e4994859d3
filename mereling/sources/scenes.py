"""Scene folders: the catalogue of band files, and rasters where a codec is installed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.functions import names


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One row per band file: scene, its fields, granule, resolution, band, path. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jp2").load(folder).select("path", "length")
    part = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit(""))
    rows = files.select(
        "path", "length", part(r"/([^/]+\.SAFE)/").alias("scene"), part(r"/GRANULE/([^/]+)/").alias("granule"), part(r"/IMG_DATA/R([0-9]+m)/").alias("resolution"),
        F.coalesce(part(r"_B([0-9A-Z]+)_[0-9]+m\.jp2$"), part(r"_(TCI)_[0-9]+m\.jp2$")).alias("band"))
    fields = names.scene_fields(F.col("scene"))
    return rows.where(names.is_scene(F.col("scene")) & F.col("band").isNotNull() & fields.isNotNull()).withColumn("fields", fields)


def one_granule(rows: DataFrame) -> DataFrame:
    """`rows`, or an error for a scene with several granules."""
    odd = rows.groupBy("scene").agg(F.countDistinct("granule").alias("n")).where("n <> 1").select("scene", F.lit(True).alias("_odd"))
    return rows.join(odd, "scene", "left").where(F.when(F.col("_odd"), F.raise_error(F.concat(F.lit("not one granule: "), "scene"))).otherwise(F.lit("")) == "").drop("_odd")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scene, granule and resolution, from the granules' MTD_TL.xml: scene, granule, resolution (m), crs, height, width, transform (a, c, e, f)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "MTD_TL.xml").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    part = lambda p: F.regexp_extract("path", p, 1)
    plain = F.regexp_replace("value", r"(</?)[A-Za-z0-9]+:", "$1")  # names without their spaces
    rows = files.select(part(r"/([^/]+\.SAFE)/").alias("scene"), part(r"/GRANULE/([^/]+)/").alias("granule"), plain.alias("xml"))
    rows = rows.select("scene", "granule", "xml", F.xpath_string("xml", F.lit("//HORIZONTAL_CS_CODE")).alias("crs"), F.explode(F.xpath("xml", F.lit("//Geoposition/@resolution"))).alias("resolution"))
    one = lambda group, name: F.coalesce(*(F.when(F.col("resolution") == r, F.expr(f"xpath_double(xml, '//{group}[@resolution=\"{r}\"]/{name}')")) for r in ("10", "20", "60")))
    return rows.select(
        "scene", "granule", F.col("resolution").cast("int").alias("resolution"), "crs", one("Size", "NROWS").cast("int").alias("height"), one("Size", "NCOLS").cast("int").alias("width"),
        F.struct(one("Geoposition", "XDIM").alias("a"), one("Geoposition", "ULX").alias("c"), one("Geoposition", "YDIM").alias("e"), one("Geoposition", "ULY").alias("f")).alias("transform"))


def first_scenes(scenes: DataFrame, n: int) -> DataFrame:
    """The first n scene names, in order (a chosen number of images)."""
    return scenes.where(names.is_scene(F.col("scene"))).select("scene").distinct().orderBy("scene").limit(n)


def default_scene(scenes: DataFrame) -> DataFrame:
    """One row: the first scene name with seven fields, null if there is none."""
    return scenes.where(F.endswith("scene", F.lit(names.SUFFIX)) & names.scene_fields(F.col("scene")).isNotNull()).agg(F.min("scene").alias("scene"))


def one_tile(scenes: DataFrame) -> DataFrame:
    """One row: whether all scenes share one tile, and how many tiles there are."""
    fields = names.scene_fields(F.col("scene"))
    return scenes.select(fields["tile"].alias("tile")).agg(F.countDistinct("tile").alias("tiles")).withColumn("single", F.col("tiles") == 1)


def summary(scenes: DataFrame) -> DataFrame:
    """Scenes by year, satellite, tile and month."""
    fields = names.scene_fields(F.col("scene"))
    rows = scenes.where(fields.isNotNull()).select(
        F.substring(fields["sensing_time"], 1, 4).alias("year"), fields["satellite"].alias("satellite"), fields["tile"].alias("tile"), F.substring(fields["sensing_time"], 5, 2).alias("month"))
    return rows.groupBy("year", "satellite", "tile", "month").agg(F.count(F.lit(1)).alias("n"))


def read_bands(spark: SparkSession, rows: DataFrame, n_chunks: int) -> DataFrame:
    """Blocks (scene, band, chunk, h, w, dn) of the catalogue's files, a task per file. Needs rasterio on the executors."""
    k = int(n_chunks**0.5)

    def run(batches):
        try:
            import rasterio
        except ImportError as e:
            raise RuntimeError("reading JP2 and GeoTIFF rasters needs rasterio on the executors") from e
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                with rasterio.open(row["path"]) as source:
                    image = source.read(1)
                ys, xs = (np.array_split(np.arange(n), k) for n in image.shape)
                for c in range(k * k):
                    block = image[np.ix_(ys[c // k], xs[c % k])]
                    yield pa.RecordBatch.from_pylist([{"scene": row["scene"], "band": row["band"], "chunk": c, "h": block.shape[0], "w": block.shape[1], "dn": block.ravel().tolist()}], schema=pa.schema(
                        [("scene", pa.string()), ("band", pa.string()), ("chunk", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("dn", pa.list_(pa.int32()))]))

    return rows.select("scene", "band", "path").repartition("scene", "band").mapInArrow(run, "scene string, band string, chunk int, h int, w int, dn array<int>")
