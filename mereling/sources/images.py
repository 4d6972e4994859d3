"""Patch images: PNG files in folders by class, and partitioned Parquet."""

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from mereling.functions import names
from mereling.sources.paths import file_system


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(name, class by folder, h, w, px) of the PNG files under path/class=.../ or path/.../; grey, or the mean of the channels."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    image = F.col("image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            names, hs, ws, px = [], [], [], []
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], np.uint8).reshape(r["h"] * r["w"], r["channels"])[:, : min(3, r["channels"])]
                names.append(r["origin"])
                hs.append(r["h"])
                ws.append(r["w"])
                px.append(data.mean(axis=1).astype(np.int16).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()), pa.array(px, pa.list_(pa.int16()))], ["origin", "h", "w", "px"])

    flat = rows.select(image["origin"].alias("origin"), image["height"].alias("h"), image["width"].alias("w"), image["nChannels"].alias("channels"), image["data"].alias("data"))
    out = flat.mapInArrow(run, "origin string, h int, w int, px array<smallint>")
    return out.select(F.regexp_extract("origin", r"([^/]+)$", 1).alias("name"), F.regexp_extract("origin", r"(?:class=)?([^/]+)/[^/]+$", 1).alias("class"), "h", "w", "px")


def png(px: list[int], h: int, w: int) -> bytes:
    """An 8-bit grey PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(px[y * w : (y + 1) * w]) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class PngWriter(DataSourceArrowWriter):
    """A file per row: path/class=.../name, with the name's own folder replaced only when the job commits."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, path = file_system(self.path)
        done = []
        for batch in iterator:
            for r in batch.to_pylist():
                folder = f"{path}/class={r['class']}"
                fs.create_dir(folder)
                done.append(f"{folder}/.{r['name']}")
                with fs.open_output_stream(done[-1]) as out:
                    out.write(png(r["px"], r["h"], r["w"]))
        return _Written(done)

    def commit(self, messages):
        fs, _ = file_system(self.path)
        for p in sorted({p for m in messages if m for p in m.paths}):
            folder, _, name = p.rpartition("/")
            fs.move(p, f"{folder}/{name[1:]}")

    def abort(self, messages):
        fs, _ = file_system(self.path)
        for p in (p for m in messages if m for p in m.paths):
            fs.delete_file(p)


class PngDataSource(DataSource):
    @classmethod
    def name(cls):
        return "patch_png"

    def writer(self, schema, overwrite):
        return PngWriter(self.options["path"])


def write_png(patches: DataFrame, path: str) -> None:
    """Patches (class, name, h, w, px) as PNG files."""
    patches.sparkSession.dataSource.register(PngDataSource)
    patches.select("class", "name", "h", "w", "px").write.format("patch_png").mode("append").save(path)


def write_parquet(patches: DataFrame, path: str) -> None:
    """Patches by class and scene_prefix; a scene that is written again replaces its own, and no other's."""
    patches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("class", "scene_prefix").parquet(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, chunk, minichunk) of the PNG files at `path`, -1 for names that aren't mini-chunks; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path).select("path")
    rows = files.withColumn("name", F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)))
    return rows.withColumn("_k", names.chunk_key(F.col("name"))).select("path", "name", "_k.*")


def containing(files: DataFrame, parts: DataFrame, name: str, part: str) -> DataFrame:
    """Rows of `files` whose name contains one of the names in `parts`, a short list (it is sent to all tasks)."""
    return files.join(F.broadcast(parts.select(F.col(part).alias("_part")).distinct()), F.contains(F.col(name), F.col("_part")), "left_semi")


def write_mini_chunks(cut: DataFrame, path: str) -> None:
    """Mini-chunks (scene, multiplier, ...) as Parquet by scene and multiplier; a pair that is written again replaces its own, and no other's."""
    cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene", "multiplier").parquet(path)


def stale(existing: DataFrame, expected: int, rebuild: bool = False) -> bool:
    """Whether cut mini-chunks have to be cut again: on demand, or when fewer are there than expected."""
    return rebuild or existing.limit(expected).count() < expected
