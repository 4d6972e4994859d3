"""Cloud classes from overlapping patches: blocks with a halo of their neighbours, predictions blended where they overlap.

A block sends each of its eight neighbours the strip that lies in the neighbour's halo; a neighbour is known from the
grid, so this is one shuffle of the halos besides the blocks, and a group is nine strips at most. The predictor sees
a block with its halo. Its scores go back the same way: each pixel gets the weighted mean of all patches that
hold it, with weights that rise from 0 at a patch's edge to 1 over the overlap (but not at the image's border), so no
seam is left where patches meet, and what a patch's edge does to a prediction has no weight. Strips between the same
two chunks have the same places in every scene, so all scenes of an Arrow batch (64 MB at most, by Spark's default)
are cut and added up together.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mereling.functions import grid

Window = tuple[int, int, int, int]  # y0, y1, x0, x1


def _cuts(n: int, k: int) -> np.ndarray:
    """Where each of k nearly equal parts begins, the longer ones first, and the end."""
    size, longer = divmod(n, k)
    return np.cumsum([0] + [size + 1] * longer + [size] * (k - longer))


class Patches:
    """The windows of all chunks of an image, with and without a halo."""

    def __init__(self, height: int, width: int, n_chunks: int, overlap: int, reach: int = 1):
        self.k, self.overlap, self.reach = grid.per_side(n_chunks), overlap, max(reach, 1)
        self.rows, self.cols = _cuts(height, self.k), _cuts(width, self.k)
        self.height, self.width = height, width
        if 0 < overlap < reach:
            raise ValueError("an overlap that is narrower than the predictor's reach leaves seams")
        if self.k > 1 and overlap > min(np.diff(self.rows).min(), np.diff(self.cols).min()):
            raise ValueError("an overlap that is wider than a chunk would need more than the neighbours")

    def window(self, chunk: int, halo: int = 0) -> Window:
        """y0, y1, x0, x1 of a chunk and a halo within the image."""
        r, c = divmod(chunk, self.k)
        return max(self.rows[r] - halo, 0), min(self.rows[r + 1] + halo, self.height), max(self.cols[c] - halo, 0), min(self.cols[c + 1] + halo, self.width)

    def near(self, chunk: int) -> list[int]:
        """A chunk and its neighbours."""
        r, c = divmod(chunk, self.k)
        return [y * self.k + x for y in range(max(r - 1, 0), min(r + 2, self.k)) for x in range(max(c - 1, 0), min(c + 2, self.k))]

    def weights(self, chunk: int) -> np.ndarray:
        """Of a chunk with its halo: 0 within the reach of its edges, 1 from the overlap's width on, 1 up to the image's border."""
        y0, y1, x0, x1 = self.window(chunk, self.overlap)

        def ramp(low, high, size):
            at = np.arange(low, high)
            up = np.where(low == 0, np.inf, at - low)
            down = np.where(high == size, np.inf, high - 1 - at)
            return np.clip((np.minimum(up, down) - self.reach + 1) / max(self.overlap - self.reach + 1, 1), 0, 1)

        return np.outer(ramp(y0, y1, self.height), ramp(x0, x1, self.width))


def _meet(a: Window, b: Window) -> Window | None:
    """What two windows share."""
    y0, y1, x0, x1 = max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3])
    return (y0, y1, x0, x1) if y0 < y1 and x0 < x1 else None


def _part(planes: np.ndarray, window: Window, part: Window) -> np.ndarray:
    """Of planes (..., h, w) that fill a window, the view of a part of it."""
    return planes[..., part[0] - window[0] : part[1] - window[0], part[2] - window[2] : part[3] - window[2]]


def _by_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Each chunk of a batch, with its rows (of different scenes)."""
    chunk = batch.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
        if len(rows):
            yield int(chunk[rows[0]]), rows


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Each of the first axis as a list."""
    size = values[0].size
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size, pa.int32()), pa.array(values.ravel(), kind))


def _sent(patches: Patches, scenes: pa.Array, chunk: int, planes: np.ndarray, halo: int, into: int) -> Iterator[pa.RecordBatch]:
    """The strips of a chunk's planes (scenes, n, h, w; with their halo) that lie in its neighbours' windows with the halo `into`."""
    window, same = patches.window(chunk, halo), lambda v: pa.array(np.full(len(scenes), v), pa.int32())
    for target in patches.near(chunk):
        part = _meet(window, patches.window(target, into))
        if part:
            yield pa.RecordBatch.from_arrays([scenes, same(target), same(chunk), _lists(_part(planes, window, part), pa.float64())], ["scene", "chunk", "source", "data"])


def _joined(patches: Patches, strips: pa.ListArray, chunk: int, n: int, halo: int, into: int) -> np.ndarray:
    """Lists of strips added up in a chunk's window with the halo `into`, in the order of their sources: planes (lists, n, h, w)."""
    window, every = patches.window(chunk, into), strips.flatten()
    out = np.zeros((len(strips), n, window[1] - window[0], window[3] - window[2]))
    at, source, data = np.repeat(np.arange(len(strips)), strips.value_lengths()), every.field("source").to_numpy(), every.field("data")
    for s in np.unique(source).tolist():
        own, part = np.flatnonzero(source == s), _meet(patches.window(s, halo), window)
        values = data.take(pa.array(own)).flatten().to_numpy()
        np.add.at(_part(out, window, part), at[own], values.reshape(len(own), n, part[1] - part[0], part[3] - part[2]))
    return out


def blended_classes(blocks: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], n_classes: int, height: int, width: int, n_chunks: int, overlap: int, bands: tuple[str, ...] = ("red", "green", "nir"), reach: int = 1) -> DataFrame:
    """scene, chunk, h, w, scores (array<double>, class after class, row-major), cls (array<int>, the first best class).

    blocks: (scene, chunk, h, w, and an array per band) of all chunks of an image; null pixels are 0 to the predictor.
    predictor: (bands, rows, columns) to scores (n_classes, rows, columns); it runs on the executors, one patch at a
    time. reach: how many pixels a prediction looks to each side; so near a patch's edge it has no weight. Scenes without
    some of their blocks see zeros there.
    """
    patches, kind = Patches(height, width, n_chunks, overlap, reach), blocks.schema["scene"].dataType.simpleString()

    def halos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in _by_chunk(batch):
                y0, y1, x0, x1 = patches.window(chunk)
                own = batch.take(pa.array(rows))
                planes = np.stack([np.nan_to_num(own.column(b).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(rows), y1 - y0, x1 - x0) for b in bands], axis=1)
                yield from _sent(patches, own.column("scene"), chunk, planes, 0, overlap)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in _by_chunk(batch):
                own, weight = batch.take(pa.array(rows)), patches.weights(chunk)
                seen = _joined(patches, own.column("strips"), chunk, len(bands), 0, overlap)
                scores = np.empty((len(rows), n_classes + 1, *seen.shape[2:]))
                scores[:, -1] = weight
                for planes, out in zip(seen, scores, strict=True):
                    out[:-1] = np.asarray(predictor(planes), float) * weight
                yield from _sent(patches, own.column("scene"), chunk, scores, overlap, 0)

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in _by_chunk(batch):
                own = batch.take(pa.array(rows))
                total = _joined(patches, own.column("strips"), chunk, n_classes + 1, overlap, 0)
                scores = total[:, :-1] / np.where(total[:, -1:] > 0, total[:, -1:], 1)
                size = [pa.array(np.full(len(rows), v), pa.int32()) for v in scores.shape[2:]]
                yield pa.RecordBatch.from_arrays([own.column("scene"), own.column("chunk"), *size, _lists(scores, pa.float64()), _lists(scores.argmax(axis=1).astype(np.int32), pa.int32())], ["scene", "chunk", "h", "w", "scores", "cls"])

    strips = f"scene {kind}, chunk int, source int, data array<double>"
    gather = lambda sent: sent.groupBy("scene", "chunk").agg(F.collect_list(F.struct("source", "data")).alias("strips"))
    sent = blocks.select("scene", F.col("chunk").cast("int").alias("chunk"), *bands).mapInArrow(halos, strips)
    back = gather(sent).mapInArrow(predict, strips)
    return gather(back).mapInArrow(blend, f"scene {kind}, chunk int, h int, w int, scores array<double>, cls array<int>")
