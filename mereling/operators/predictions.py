"""Predictions: best class, order, the wide table, and the best of each chunk."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mereling.config import CLASS_NAMES
from mereling.functions import names, pixels

MINI_CHUNKS = range(25)


def decide(logits: DataFrame, column: str = "logits", classes: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """`logits` with label (capitals; the first of equals) and confidence (percent)."""
    return logits.withColumns({"label": pixels.best_class(F.col(column), classes), "confidence": pixels.confidence(F.col(column))})


def in_order(predictions: DataFrame) -> DataFrame:
    """By chunk and mini-chunk; rows whose name didn't parse (-1, -1) come first."""
    return predictions.orderBy("chunk", "minichunk")


def files_in_order(files: DataFrame, name: str = "name") -> DataFrame:
    """File names by their chunk and mini-chunk, others last."""
    key = names.chunk_key(F.col(name))
    place = lambda f: F.nullif(key[f], F.lit(-1))
    return files.orderBy(place("chunk").asc_nulls_last(), place("minichunk").asc_nulls_last(), name)


def chunk_range(files: DataFrame, start: int, n: int | None) -> DataFrame:
    """Rows (chunk, ...) of n chunks from `start`; all that follow without n."""
    out = files.where(F.col("chunk") >= start)
    return out if n is None else out.where(F.col("chunk") < start + n)


def slice_in_order(files: DataFrame, start: int, n: int | None, by: str = "scene", name: str = "name") -> DataFrame:
    """The n files from place `start` (from 0) of each scene, in the order of their chunks; all that follow without n."""
    key = names.chunk_key(F.col(name))
    order = Window.partitionBy(by).orderBy(*(F.nullif(key[f], F.lit(-1)).asc_nulls_last() for f in ("chunk", "minichunk")), name)
    placed = files.withColumn("_at", F.row_number().over(order) - 1).where(F.col("_at") >= start)
    return (placed if n is None else placed.where(F.col("_at") < start + n)).drop("_at")


def wide(predictions: DataFrame) -> DataFrame:
    """One row per chunk with 25 cells `LABEL confidence`, null where none; rows that didn't parse are left out."""
    cell = F.concat_ws(" ", "label", F.format_string("%.2f", "confidence"))
    rows = predictions.where("chunk >= 0").select("chunk", F.col("minichunk").alias("_m"), cell.alias("_cell"))
    return rows.groupBy("chunk").pivot("_m", list(MINI_CHUNKS)).agg(F.max("_cell"))


def csv_lines(predictions: DataFrame) -> DataFrame:
    """The lines of the prediction file: (chunk, value), a trailing comma each; without the two header lines."""
    cells = [F.concat(F.coalesce(F.col(f"`{m}`"), F.lit("")), F.lit(",")) for m in MINI_CHUNKS]
    return wide(predictions).select("chunk", F.concat(F.col("chunk").cast("string"), F.lit(","), *cells).alias("value"))


# The two header lines.
CSV_HEADER = [",minichunks,", "chunk," + ",".join(map(str, MINI_CHUNKS))]


def read_csv_lines(lines: DataFrame, n: int | None = None) -> DataFrame:
    """Lines (line_no, value) of a prediction file as chunk, minichunk, cell; n: only the first n after the header (as many as there are responses)."""
    rows = lines.where("line_no >= 2" if n is None else f"line_no >= 2 and line_no < {n + 2}").select(F.split("value", ",").alias("f"))
    cells = rows.select(F.get("f", F.lit(0)).try_cast("int").alias("chunk"), F.posexplode(F.slice("f", 2, len(MINI_CHUNKS))).alias("minichunk", "cell"))
    return cells.where("chunk is not null and cell <> ''")


def best_per_chunk(predictions: DataFrame, order: str = "ord") -> DataFrame:
    """Of each chunk, the row with the greatest confidence; the first of equals. Null chunks and confidences are left out.

    A chunk's rows are combined before they are shuffled.
    """
    rest = [c for c in predictions.columns if c not in ("chunk", "confidence", order)]
    best = F.max_by(F.struct("confidence", order, *rest), F.struct(F.col("confidence"), -F.col(order)))
    rows = predictions.where("chunk is not null and confidence is not null").groupBy("chunk").agg(best.alias("b"))
    return rows.select("chunk", "b.*")
