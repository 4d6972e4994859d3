"""Nearest vectors by largest inner product, found by counting collisions under virtual rehashing.

Vectors lie in blocks of bounded size. A block's index is one sorted array of projected values for
each of M random directions. A query's windows on these arrays are centred on its own projections;
rehashing widens them all by the radius R, R is raised step by step from a part of the k-th best distance in a
small sample, and each step counts only what came into the windows (or what is still out, if that
is less). A vector that is in at least `threshold` of the M windows is verified by its
inner product. The search in a block ends when the k-th best verified vector is not farther than R: a vector at
distance R or less falls into each window with probability P(|z| <= WIDTH) at least, so the binomial
distribution gives a threshold that it misses with probability MISS at most. Nothing else ends a search:
no cap on candidates, windows or rows; if need be the windows grow until they hold the block, which is exact.

Inner products become distances by one more component: with the greatest norm N, a vector x is
(x / N, sqrt(1 - |x|^2 / N^2)), a query q is (q / |q|, 0), and the squared distance is 2 - 2 q.x / (N |q|).

The stated queries meet each block as a stream: a task holds one block's index and a batch of queries,
whatever the number of either. Each block gives a query's k nearest of its own; the k best of those stay.

Rows without an id, and vectors that are null, empty, zero, or hold a null, infinite or NaN component, take no
part, nor do those whose dimension isn't that of most rows (of equal counts, the larger). Of rows that share an id,
the least vector asks, and all of them can be found by others. Fewer candidates than k are all returned. An
empty table gives no rows. Columns other than id and vector are not read.
"""

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directions, half a window in units of the radius, and how often a vector within the radius may be missed.
M, WIDTH, MISS = 64, 1.5, 0.04
#: Vectors of a block, and those of its sample that each query looks at first.
BLOCK, SAMPLE = 1 << 14, 256
#: The first radius, as a part of the k-th best distance known, and the factor from step to step.
START, STEP = 0.75, 1.2
#: More than the errors of inner products in single precision; near the k-th place double precision decides.
SLACK = 1e-5
SEED = 20
#: More than twice the largest projection of a vector of norm 1.
APART = 256.0


def threshold(m: int, width: float, miss: float) -> int:
    """The most collisions of m that a vector within the radius reaches with probability 1 - miss."""
    p = erf(width / sqrt(2))
    below, least = 0.0, 0
    while (below := below + comb(m, least) * p**least * (1 - p) ** (m - least)) <= miss:
        least += 1
    return max(least, 1)


class Index:
    """Sorted projections of one block's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, m: int = M, width: float = WIDTH, miss: float = MISS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norm, self.m, self.width = ids[order], vectors[order], norm, m, width
        self.least = threshold(m, width, miss)
        random = np.random.default_rng(SEED)
        directions = random.standard_normal((vectors.shape[1] + 1, m))
        unit = self.vectors / norm
        rest = np.sqrt(np.maximum(1 - (unit * unit).sum(axis=1), 0))
        values = (unit @ directions[:-1] + np.outer(rest, directions[-1])).T
        order = np.argsort(values, axis=1)
        # one array after the other, each moved by APART, so that one search finds all windows' ends
        self.moved = np.arange(m) * APART
        self.values = (np.take_along_axis(values, order, axis=1) + self.moved[:, None]).ravel()
        self.order, self.directions = order.ravel(), directions[:-1]
        self.unit = unit.astype(np.float32)
        self.sample = np.sort(random.permutation(len(ids))[:SAMPLE])

    def near(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products with the unit query over the greatest norm, to 1e-6 or so."""
        return self.unit[places] @ query

    def counted(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, new_low: np.ndarray, new_high: np.ndarray) -> np.ndarray:
        """Collisions after the windows [low, high) became wider: what came in is added, or what is out is left, whichever is less."""
        n = len(self.ids)
        edge = np.arange(self.m) * n
        inside = np.concatenate((new_low, high)), np.concatenate((low, new_high))
        outside = np.concatenate((edge, new_high)), np.concatenate((new_low, edge + n))
        take = min(inside, outside, key=lambda x: int((x[1] - x[0]).sum()))
        parts = [self.order[a:b] for a, b in zip(take[0].tolist(), take[1].tolist(), strict=True) if b > a]
        found = np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)
        return counts + found if take is inside else self.m - found

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and inner products of the k nearest found, and how many vectors were verified."""
        n, length = len(self.ids), sqrt(query @ query)
        unit = query / length
        centre, small = unit @ self.directions, unit.astype(np.float32)
        others = self.ids != query_id
        out_of, others_left = int(others.sum()), others.copy()
        at = self.sample[others[self.sample]]
        scores = self.near(at, small)
        others_left[at] = False
        ends = lambda x, side: np.searchsorted(self.values, np.clip(x, -APART / 2, APART / 2) + self.moved, side)
        low = high = ends(centre, "left")
        counts, radius = np.zeros(n, np.int64), 0.0
        while len(at) < out_of:
            best = np.partition(scores, len(scores) - k)[len(scores) - k] if len(at) >= k else -1.0
            far = sqrt(max(2 - 2 * float(best) + SLACK, 0.0))
            if far <= radius:
                break
            radius = min(max(radius * STEP, far * START), far) if radius < 2 else 2 * radius
            new = ends(centre - radius * self.width, "left"), ends(centre + radius * self.width, "right")
            counts = self.counted(counts, low, high, *new)
            low, high = new
            fresh = np.flatnonzero((counts >= self.least) & others_left)
            others_left[fresh] = False
            at, scores = np.concatenate((at, fresh)), np.concatenate((scores, self.near(fresh, small)))
        verified = len(at)
        if verified > k:  # those that may be among the first k, ties too
            at = at[scores >= np.partition(scores, verified - k)[verified - k] - SLACK]
        exact = (self.vectors[at] * query).sum(axis=1)
        first = np.lexsort((at, -exact))[:k]  # places are in the order of ids
        return self.ids[at[first]], exact[first], verified


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite and not all zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k nearest of each query: query_id, rank int (from 1), vec_id, score double; of equal scores, the smaller vec_id.

    queries: rows (id, vector) whose own id is not among their candidates. score: the inner product in double
    precision. The number of rows, the dimension and the greatest norm are aggregates; nothing else reaches the driver.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if all(df.schema[vector_col].dataType.simpleString() == "array<float>" for df in (vectors, queries)) else "array<double>"
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = pick(vectors)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("v").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    most = sizes.orderBy(F.desc("n"), F.desc("dimension")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, longest = most.dimension, most.norm
    blocks = -(-most.n // block)
    fitting = lambda df: df.where(F.size("v") == dimension)
    # by place in the table: rows with one id or one vector are dealt out like any others
    held = fitting(rows).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    asked = fitting(pick(queries)).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, parts, index = None, [], [], None
        for batch in batches:
            block_of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block_of) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(asks)], strict=True):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if block_of[a] != own:
                    own, ids, parts, index = block_of[a], [], [], None
                if not asks[a]:
                    ids.append(part.column(2).to_numpy())
                    parts.append(_matrix(part.column(3), dimension))
                elif ids:
                    if index is None:
                        index, parts = Index(np.concatenate(ids), np.concatenate(parts), longest), []
                    for low in range(0, b - a, 512):
                        yield _found(index, part.slice(low, 512), dimension, k)

    dealt = held.union(asked).repartitionByRange(4 * blocks, "block").sortWithinPartitions("block", "asks")  # a task for each block
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(index: Index, part: pa.RecordBatch, dimension: int, k: int) -> pa.RecordBatch:
    out = [(np.full(len(ids), query, np.int64), ids, scores) for query, v in zip(part.column(2).to_pylist(), _matrix(part.column(3), dimension), strict=True) for ids, scores, _ in [index.search(query, v, k)]]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["query_id", "vec_id", "score"])
