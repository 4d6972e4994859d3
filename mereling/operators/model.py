"""Classification: split, resize, a multilayer perceptron, and a convolutional network."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.config import Settings


def in_validation(key: Column, seed: int = 123, share: float = 0.2) -> Column:
    """Whether a row is in the validation part, by a hash of its key: the same in every run and partitioning."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    return digest % 1000 < int(round(share * 1000))


def split(rows: DataFrame, key: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    held = in_validation(F.col(key), settings.seed, settings.validation_share)
    return rows.where(~held), rows.where(held)


def bilinear(image: np.ndarray, side: int) -> np.ndarray:
    """An image resized to side x side, pixel centres half in, edges repeated."""
    h, w = image.shape[:2]
    at = lambda n: np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def resize(patches: DataFrame, side: int = 31) -> DataFrame:
    """Patches (h, w, px) with px resized to side x side as floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws = batch.column("h").to_pylist(), batch.column("w").to_pylist()
            out = [bilinear(np.array(p, float).reshape(h, w), side).ravel() for p, h, w in zip(batch.column("px").to_pylist(), hs, ws, strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "px"} | {"h": pa.array([side] * len(out), pa.int32()), "w": pa.array([side] * len(out), pa.int32()), "px": pa.array(out, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema})

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    kinds = {"px": ArrayType(DoubleType()), "h": IntegerType(), "w": IntegerType()}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in patches.schema])
    return patches.mapInArrow(run, schema)


def rescale(patches: DataFrame) -> DataFrame:
    """Patches with grey values 0 .. 255 as 0 .. 1."""
    return patches.withColumn("px", F.transform("px", lambda v: v / 255.0))


def fit_perceptron(rows: DataFrame, features: str = "px", label: str = "label", hidden: int = 32, steps: int = 60, seed: int = 123) -> MultilayerPerceptronClassificationModel:
    """A perceptron with one hidden layer; features are arrays of one length, labels 0 .. n-1."""
    shape = rows.agg(F.max(F.size(features)), F.max(label)).first()
    data = rows.select(array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[shape[0], hidden, int(shape[1]) + 1], maxIter=steps, seed=seed).fit(data)


def predict_perceptron(model: MultilayerPerceptronClassificationModel, rows: DataFrame, features: str = "px") -> DataFrame:
    """`rows` with predicted (class number) and confidence (percent)."""
    vector = rows.withColumn("_v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    out = model.setFeaturesCol("_v").setPredictionCol("_p").setProbabilityCol("_s").setRawPredictionCol("_r").transform(vector)
    return out.withColumns({"predicted": F.col("_p").cast("int"), "confidence": 100 * F.array_max(vector_to_array("_s"))}).drop("_v", "_p", "_s", "_r")


def convolution_weights(n_classes: int, side: int = 31, seed: int = 123) -> list[np.ndarray]:
    """He-scaled weights of the network: three 3x3 convolutions (16, 32, 64) with pooling, dense 128, dense n."""
    rng = np.random.default_rng(seed)
    flat = (side // 2 // 2 // 2) ** 2 * 64
    shapes = [(3, 3, 3, 16), (3, 3, 16, 32), (3, 3, 32, 64), (flat, 128), (128, n_classes)]
    return [w for s in shapes for w in (rng.normal(0, np.sqrt(2 / np.prod(s[:-1])), s), np.zeros(s[-1]))]


def _windows(x: np.ndarray) -> np.ndarray:
    """The 3 x 3 surroundings of each pixel, zeros outside: n, h, w, channels, 3, 3."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0))), (3, 3), axis=(1, 2))


def _quarters(x: np.ndarray) -> np.ndarray:
    """2 x 2 blocks, the odd last row and column left out: n, h, 2, w, 2, channels."""
    h, w = x.shape[1] // 2, x.shape[2] // 2
    return x[:, : 2 * h, : 2 * w].reshape(len(x), h, 2, w, 2, -1)


def convolution_forward(images: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Logits of grey images (n, side, side) with values 0 .. 255."""
    x = np.repeat(images[..., None] / 255.0, 3, axis=3)
    for kernel, bias in zip(weights[0:6:2], weights[1:6:2], strict=True):
        x = _quarters(np.maximum(np.einsum("nhwcij,ijcf->nhwf", _windows(x), kernel, optimize=True) + bias, 0)).max(axis=(2, 4))
    x = np.maximum(x.reshape(len(x), -1) @ weights[6] + weights[7], 0)
    return x @ weights[8] + weights[9]


def convolution_gradients(images: np.ndarray, labels: np.ndarray, weights: list[np.ndarray], dropped: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """The sum over images of the cross-entropy, and of its gradients by weight. dropped: factors of the last pooled layer's values (n, h, w, channels)."""
    x, kept = np.repeat(images[..., None] / 255.0, 3, axis=3), []
    for kernel, bias in zip(weights[0:6:2], weights[1:6:2], strict=True):
        full = np.maximum(np.einsum("nhwcij,ijcf->nhwf", _windows(x), kernel, optimize=True) + bias, 0)
        pooled = _quarters(full).max(axis=(2, 4))
        kept.append((x, full, pooled))
        x = pooled
    flat = (x if dropped is None else x * dropped).reshape(len(x), -1)
    hidden = np.maximum(flat @ weights[6] + weights[7], 0)
    logits = hidden @ weights[8] + weights[9]
    shares = np.exp(logits - logits.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    at = np.arange(len(labels))
    loss = float(-np.log(np.maximum(shares[at, labels], 1e-12)).sum())
    d = shares
    d[at, labels] -= 1
    out = [hidden.T @ d, d.sum(axis=0)]
    d = (d @ weights[8].T) * (hidden > 0)
    out = [flat.T @ d, d.sum(axis=0), *out]
    d = (d @ weights[6].T).reshape(x.shape)
    if dropped is not None:
        d = d * dropped
    for (before, full, pooled), kernel in zip(reversed(kept), reversed(weights[0:6:2]), strict=True):
        best = _quarters(full) == pooled[:, :, None, :, None, :]
        spread = best * (d[:, :, None, :, None, :] / best.sum(axis=(2, 4), keepdims=True))
        wide = np.zeros_like(full)
        n, h, _, w, _, f = best.shape
        wide[:, : 2 * h, : 2 * w] = spread.reshape(n, 2 * h, 2 * w, f)
        wide *= full > 0
        out = [np.einsum("nhwcij,nhwf->ijcf", _windows(before), wide, optimize=True), wide.sum(axis=(0, 1, 2)), *out]
        d = np.einsum("nhwfij,ijcf->nhwc", _windows(wide), kernel[::-1, ::-1], optimize=True)
    return loss, out


def augment(images: np.ndarray, rng: np.random.Generator, turn: float = 0.1, zoom: float = 0.1) -> np.ndarray:
    """Images (n, side, side), each mirrored or not, turned by up to `turn` of a circle and zoomed by up to `zoom`, edges mirrored."""
    n, side = images.shape[:2]
    angle, scale = rng.uniform(-turn, turn, n) * 2 * np.pi, 1 + rng.uniform(-zoom, zoom, n)
    mirror = np.where(rng.random(n) < 0.5, -1.0, 1.0)
    middle = (side - 1) / 2
    y, x = np.mgrid[:side, :side] - middle
    cos, sin = (f(angle)[:, None, None] * scale[:, None, None] for f in (np.cos, np.sin))
    fold = lambda v: middle - np.abs((v + middle) % (2 * max(side - 1, 1)) - (side - 1)) + middle
    ys, xs = fold(sin * x + cos * y), fold((cos * x - sin * y) * mirror[:, None, None])
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, side - 1), np.minimum(x0 + 1, side - 1)
    fy, fx, k = ys - y0, xs - x0, np.arange(n)[:, None, None]
    top, low = images[k, y0, x0] * (1 - fx) + images[k, y0, x1] * fx, images[k, y1, x0] * (1 - fx) + images[k, y1, x1] * fx
    return top * (1 - fy) + low * fy


def _added(table: pa.Table) -> pa.Table:
    """One row: the sums of all workers added up in the workers' order, so the last bits don't depend on which comes first."""
    rows = sorted(table.to_pylist(), key=lambda r: r["worker"])
    return pa.table({"n": [sum(r["n"] for r in rows)], "sums": pa.array([sum(np.frombuffer(r["sums"]) for r in rows).tobytes()], pa.binary())})


def fit_convolution(rows: DataFrame, n_classes: int, key: str = "key", label: str = "label", settings: Settings = Settings(), epochs: int | None = None, workers: int = 16) -> list[np.ndarray]:
    """Weights of the network from patches (px of patch_side squared, label 0 .. n_classes - 1, key).

    Data-parallel Adam: the rows are dealt to `workers` tasks and kept there; a hash of key and epoch
    puts each row into one batch of about `settings.batch`; each task gives one sum of gradients
    (0.8 MB) per batch, and one task adds these up, so the driver gets one sum per batch. Rows are
    augmented and dropped out anew in each epoch.
    """
    side, epochs = settings.patch_side, settings.epochs if epochs is None else epochs
    data = rows.select(F.xxhash64(key).alias("key"), F.transform("px", lambda v: v.cast("float")).alias("px"), F.col(label).cast("int").alias("label")).repartition(workers, "key").persist()
    spark = rows.sparkSession
    weights = convolution_weights(n_classes, side, settings.seed)
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    try:
        batches = max(1, -(-data.count() // settings.batch))
        for epoch in range(epochs):
            for number in range(batches):
                shared = spark.sparkContext.broadcast(weights)

                def run(parts: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
                    n, total = 0, [np.zeros_like(w) for w in shared.value]
                    for part in parts:
                        if not part.num_rows:
                            continue
                        keys = part.column("key").to_numpy().view(np.uint64)
                        rng = np.random.default_rng([settings.seed, epoch, int(np.bitwise_xor.reduce(keys))])
                        images = augment(part.column("px").flatten().to_numpy().reshape(-1, side, side).astype(float), rng)
                        pooled = side // 8
                        dropped = (rng.random((len(images), pooled, pooled, 64)) >= settings.dropout) / (1 - settings.dropout)
                        _, gradients = convolution_gradients(images, part.column("label").to_numpy(), shared.value, dropped)
                        total = [a + b for a, b in zip(total, gradients, strict=True)]
                        n += len(images)
                    if n:
                        worker = TaskContext.get().partitionId()
                        yield pa.RecordBatch.from_arrays([pa.array([worker], pa.int32()), pa.array([n]), pa.array([np.concatenate([g.ravel() for g in total]).tobytes()], pa.binary())], ["worker", "n", "sums"])

                own = data.where(F.pmod(F.xxhash64("key", F.lit(epoch)), F.lit(batches)) == number).mapInArrow(run, "worker int, n long, sums binary")
                sums = own.groupBy().applyInArrow(_added, "n long, sums binary").collect()  # one row
                shared.destroy()
                if not sums:
                    continue
                flat = sum(np.frombuffer(r["sums"]) for r in sums) / sum(r["n"] for r in sums)
                cuts = np.cumsum([w.size for w in weights])[:-1]
                gradients = [g.reshape(w.shape) for g, w in zip(np.split(flat, cuts), weights, strict=True)]
                step += 1
                mean = [0.9 * m + 0.1 * g for m, g in zip(mean, gradients, strict=True)]
                square = [0.999 * s + 0.001 * g * g for s, g in zip(square, gradients, strict=True)]
                weights = [w - settings.learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7) for w, m, s in zip(weights, mean, square, strict=True)]
    finally:
        data.unpersist()
    return weights


def save_weights(spark: SparkSession, weights: list[np.ndarray], path: str) -> None:
    """Write the weights of a network; never over others."""
    rows = [(k, list(w.shape), w.ravel().tolist()) for k, w in enumerate(weights)]
    spark.createDataFrame(rows, "k int, shape array<int>, data array<double>").coalesce(1).write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> list[np.ndarray]:
    return [np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).orderBy("k").collect()]  # ten arrays


def predict_convolution(patches: DataFrame, weights: list[np.ndarray], side: int = 31, batch_size: int = 256) -> DataFrame:
    """Patches (h, w, px) with logits, in batches; weights are broadcast (under 1 MB)."""
    shared = patches.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, batch_size):
                batch = whole.slice(low, batch_size)
                images = np.array([bilinear(np.array(p, float).reshape(h, w), side) for p, h, w in zip(batch.column("px").to_pylist(), batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True)])
                logits = convolution_forward(images, shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(logits), pa.list_(pa.float64()))], [*batch.schema.names, "logits"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return patches.mapInArrow(run, StructType([*patches.schema.fields, StructField("logits", ArrayType(DoubleType()))]))


def load(spark: SparkSession, folder: str, name: str) -> MultilayerPerceptronClassificationModel:
    """The model in `folder` whose name contains `name`; an error if none or several do."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base) if name in s.getPath().getName()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} models in {folder} have {name!r} in their name")
    return MultilayerPerceptronClassificationModel.load(str(found[0]))


def save(model, path: str) -> None:
    """Write a model; never over another."""
    model.write().save(path)
