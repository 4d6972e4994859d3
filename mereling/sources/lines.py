"""Text files as numbered lines, and back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, value) of all text files at `path`; blank lines count, a last newline doesn't.

    A file is read whole by one task, for only then do its lines have numbers. Label and
    prediction files have a line per chunk.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n$", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).select("file", F.col("line_no").cast("bigint").alias("line_no"), "value")


def or_seed(spark: SparkSession, path: str, seed: str) -> DataFrame:
    """The working file, or the seed where there is none; the seed is never written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(spark, path if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else seed)


def write(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines (file, line_no, value) as one text file per `file`, in order, under `path`/file=..."""
    rows = lines.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "line_no", "value").repartition("file").sortWithinPartitions("file", "line_no")
    rows.select("file", "value").write.mode(mode).partitionBy("file").text(path)
