"""Intermediate tables in the folder that the driver and all executors share.

A job's intermediate results are written as Parquet below `spark.checkpoint.dir`, so a lost
executor costs a re-read, not a re-computation, and a later join may split skewed partitions
(a written table has no partitioning that would forbid it).
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_inside: ContextVar[list | None] = ContextVar("inside", default=None)


def folder(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a temporary one in local mode (tests), else an error:
    on a cluster each executor would write to a disk of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="mereling-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/") + "/mereling-" + spark.sparkContext.applicationId


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary() -> Iterator[None]:
    """Tables kept inside are deleted at the end, but those that are to stay."""
    token = _inside.set([])
    try:
        yield
    finally:
        paths = _inside.get()
        _inside.reset(token)
        for spark, path in paths:
            _delete(spark, path)


def keep(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write `df` once and return the written table. stays: it outlives the `temporary` block around it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    inside = _inside.get()
    if inside is not None and not stays:
        inside.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    _delete(spark, folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
