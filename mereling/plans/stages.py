"""The four stages over tables: label, train, predict, evaluate."""

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.config import CLASS_NAMES, Settings
from mereling.functions import grid, pixels
from mereling.operators import evaluation, labels, model, predictions, raster, rasterize, spatial
from mereling.sources import images


def water_index(bands: DataFrame, cloud: DataFrame | None, settings: Settings, layers: dict | None = None, grid_of: rasterize.Grid | None = None, **options) -> DataFrame:
    """Pixels (scene, y, x, green, nir) to (y, x, v): clouds masked, NDWI, composited over scenes, then features masked.

    Features don't depend on the scene, so they are masked once, after the composite. The composite is
    the median of each pixel, or its mean where `settings.composite` says so or compositing is off. Layers need the
    scenes' grid; buffers are in its map units. options: `systems`, `cover` and `strict_bbox` of `spatial.mask_features`.
    """
    seen = bands if cloud is None else raster.mask_classes(bands, cloud, ("green", "nir"))
    index = seen.select("scene", "y", "x", pixels.ndwi(F.col("green"), F.col("nir")).alias("v"))
    if settings.compositing and settings.composite == "median":
        out = raster.composite(index, keys=("y", "x")).select("y", "x", F.col("median").alias("v"))
    else:
        out = raster.composite_mean(index, keys=("y", "x")).select("y", "x", F.col("mean").alias("v"))
    if not layers:
        return out
    if grid_of is None:
        raise ValueError("layers need the grid of the scenes")
    return spatial.mask_features(out, layers, grid_of, settings.river_buffer, settings.reservoir_buffer, **options)


def chunk_blocks(index: DataFrame, height: int, width: int, settings: Settings) -> DataFrame:
    """Pixels (file, y, x, v) as blocks (file, chunk, h, w, px); pixels that masks removed are null."""
    k = grid.per_side(settings.n_chunks)
    every = index.withColumn("chunk", grid.chunk_of(F.col("y"), F.col("x"), F.lit(height), F.lit(width), settings.n_chunks).cast("int"))
    row, col = F.floor(F.col("chunk") / k), F.col("chunk") % k
    start = lambda p, n: grid.part_start(p, F.lit(n), k)
    size = lambda p, n: (start(p + 1, n) - start(p, n)).cast("int")
    place = ((F.col("y") - start(row, height)) * size(col, width) + F.col("x") - start(col, width)).cast("int")
    seen = every.where("v is not null").groupBy("file", "chunk").agg(F.collect_list(F.struct(place.alias("i"), "v")).alias("cells"))
    chunks = every.select("file", "chunk").distinct().join(seen, ["file", "chunk"], "left")
    return raster.fill_blocks(chunks.select("file", "chunk", size(F.floor(F.col("chunk") / k), height).alias("h"), size(F.col("chunk") % k, width).alias("w"), "cells"))


def label(lines: DataFrame, blocks: DataFrame, align: str = "chunk") -> DataFrame:
    """Label lines and index blocks to grey patches."""
    return labels.patches(labels.boxes(labels.clean(lines)), blocks, align)


def train(patches: DataFrame, settings: Settings = Settings(), steps: int = 60):
    """Patches (class, px, key) to a perceptron and its share of right answers on the held-out part."""
    number = F.array_position(F.array(*map(F.lit, CLASS_NAMES)), F.col("class")).cast("int") - 1
    rows = model.rescale(model.resize(patches, settings.patch_side)).withColumn("label", number)
    fit, held = model.split(rows, "key", settings)
    made = model.fit_perceptron(fit, steps=steps, seed=settings.seed)
    right = model.predict_perceptron(made, held).agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    return made, right


def sweep(patches: DataFrame, choices: tuple[int, ...], repeats: int = 1, settings: Settings = Settings()) -> DataFrame:
    """One row per choice of training steps and repeat: epochs, seed, accuracy on the held-out part; see `evaluation.mean_by_setting`."""
    rows = []
    for steps in choices:
        for k in range(repeats):
            own = replace(settings, seed=settings.seed + k)
            rows.append((steps, own.seed, train(patches, own, steps=steps)[1]))
    return patches.sparkSession.createDataFrame(rows, "epochs int, seed int, accuracy double")


def mini_chunks(blocks: DataFrame, share: float = pixels.PREDICT_SHARE) -> DataFrame:
    """Index blocks as grey mini-chunks: file, chunk, minichunk, h, w, px; chunks without any value are cut too."""
    low_high = blocks.groupBy("file").agg(F.min(F.array_min("px")).alias("low"), F.coalesce(F.lit(share) * F.max(F.array_max("px")), F.lit(0.0)).alias("high"))
    cut = blocks.join(low_high, "file").withColumn("win", F.explode(grid.mini_windows(F.col("h"), F.col("w"))))
    px = pixels.grey_block(grid.crop_rows(F.col("px"), F.col("w"), F.col("win")), F.col("low"), F.col("high"))
    return cut.select("file", "chunk", F.col("win.minichunk").alias("minichunk"), (F.col("win.y1") - F.col("win.y0")).alias("h"), (F.col("win.x1") - F.col("win.x0")).alias("w"), px.alias("px"))


def stored_mini_chunks(spark: SparkSession, blocks: DataFrame, path: str, scene: str, multiplier: float, rebuild: bool = False) -> DataFrame:
    """The mini-chunks of a scene from the store at `path`, cut from `blocks` and stored first if it has fewer than it should."""
    expected = blocks.count() * 25
    pick = lambda: spark.read.parquet(path).where((F.col("scene") == scene) & (F.col("multiplier") == multiplier))
    try:
        old = rebuild or images.stale(pick(), expected)
    except AnalysisException:  # nothing stored yet
        old = True
    if old:
        images.write_mini_chunks(mini_chunks(blocks, multiplier).withColumns({"scene": F.lit(scene), "multiplier": F.lit(multiplier)}), path)
    return pick().drop("scene", "multiplier")


def predict(cut: DataFrame, classifier, settings: Settings = Settings(), start: int = 0, n: int | None = None) -> DataFrame:
    """Mini-chunks to predictions: file, chunk, minichunk, label, confidence."""
    rows = model.predict_perceptron(classifier, model.rescale(model.resize(predictions.chunk_range(cut, start, n), settings.patch_side)))
    name = F.upper(F.element_at(F.array(*map(F.lit, CLASS_NAMES)), F.col("predicted") + 1))
    return rows.select("file", "chunk", "minichunk", name.alias("label"), "confidence")


def evaluate(predicted: DataFrame, lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Predictions (chunk, minichunk, label, confidence) against label lines: the metrics of each class."""
    true = evaluation.true_counts(evaluation.responses(labels.clean(lines), settings.max_label_rows))
    cells = predicted.where("chunk >= 0").select("chunk", F.concat_ws(" ", "label", F.format_string("%.2f", "confidence")).alias("cell"))
    return evaluation.metrics(evaluation.confusion(evaluation.predicted_counts(evaluation.check_lengths(cells, true), settings.confidence_threshold), true))
