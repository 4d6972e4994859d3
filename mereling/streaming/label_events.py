"""Labelling as a stream of events: append, correct and undo, folded to the current label rows."""

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling import schemas
from mereling.sources.paths import file_system


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events that are appended to `path`, as a stream."""
    return spark.readStream.schema(schemas.LABEL_EVENTS).parquet(path)


def current(events: DataFrame) -> DataFrame:
    """The last event of each chunk, (tile, chunk, version, value); chunks whose last event deletes are left out.

    For tables and streams alike; a later version wins over an earlier one that arrives late.
    """
    last = events.groupBy("tile", "chunk").agg(F.max_by(F.struct("version", "value", "deleted"), "version").alias("e"))
    return last.where(~F.coalesce(F.col("e.deleted"), F.lit(False))).select("tile", "chunk", "e.version", "e.value")


def rate(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by tile and time window; a window is complete when the watermark has passed it."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "tile").agg(F.count(F.lit(1)).alias("n")).select("tile", F.col("window.start").alias("since"), "n")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The current rows: the newest version below `path` that is complete."""
    return spark.read.parquet(_versions(path)[-1])


def _versions(path: str) -> list[str]:
    """The complete versions below `path`, oldest first."""
    fs, inner = file_system(path)
    found = fs.get_file_info(pa.fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted(f"{path}/{i.path.rsplit('/', 2)[1]}" for i in found if i.base_name == "_SUCCESS")


def fold_to(events: DataFrame, path: str, checkpoint: str, keep: int = 3):
    """Start the fold of a stream of events; each batch writes a version of the table of current rows below `path`.

    Readers take the newest complete version (`latest`) and never see it half written; the last
    `keep` versions stay. The state has one row per chunk that ever had a label.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version-{number:012d}")
        for old in _versions(path)[:-keep]:
            fs, inner = file_system(old)
            fs.delete_dir(inner)

    return current(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()
