"""Toxicity: cumulative-link ordinal regression from sparse text features to expected severity.

A text's features are its distinct lower-case tokens and their first bytes, hashed. One weight
vector is shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - sum of weights), with
ordered thresholds, and the expected severity is the sum of P(grade > k). The weights have an
L1 penalty, so few are not zero. The model is fitted on a bounded sample of labelled rows, at
most PER_GRADE of each grade and PER_TEXT features of a text, weighted back to the grades' shares; scoring reads every row.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mereling.llm import words

BITS, PREFIXES, PER_GRADE = 20, (4, 5, 6), 3000
#: Of a text of the sample, at most so many features, spread over them by hash, are used to fit; scoring uses all.
PER_TEXT = 4096


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all tokens and prefixes, not yet distinct."""
    starts, ends, first, plain = words.tokens(data, offsets)
    own, out, at = words.owners(first), [words.hashes(plain, starts, ends)], [words.owners(first)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        out.append(words.hashes(plain, starts[long], starts[long] + n, n))
        at.append(own[long])
    return np.concatenate(at), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per feature
    thresholds: np.ndarray  # one less than grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column per threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, n_grades: int, penalty: float = 1e-3, steps: int = 150, rate: float = 0.3) -> Model:
    """Minimise the weighted mean negative log-likelihood plus penalty * |weights|, by proximal
    gradient steps whose size per feature follows its past gradients. Features in fewer than 5
    texts are left out."""
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    df = np.bincount(flat, minlength=1 << BITS)
    used = np.flatnonzero(df >= 5)
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    column = place[flat]
    text = np.repeat(np.arange(n), sizes)[column >= 0]
    column = column[column >= 0]
    weight = weight / weight.sum()
    shares = np.array([weight[grades > k].sum() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - shares) / shares)  # without features, the grades' shares
    w, seen_w, seen_t = np.zeros(len(used)), np.full(len(used), 1e-10), np.full(n_grades - 1, 1e-10)
    for _ in range(steps):
        score = np.bincount(text, w[column], n)
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        up, low = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        share = np.maximum(up - low, 1e-12)
        d_up, d_low = weight * up * (1 - up) / share, weight * low * (1 - low) / share
        g_w = np.bincount(column, (d_up - d_low)[text], len(used))
        g_t = np.array([d_low[grades == k + 1].sum() - d_up[grades == k].sum() for k in range(n_grades - 1)])
        seen_w += g_w**2
        seen_t += g_t**2
        step = rate / np.sqrt(seen_w)
        w = w - step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta = np.maximum.accumulate(theta - rate / np.sqrt(seen_t) * g_t)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, theta)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grades, lists = batch.column(0), []
        for i, j, data, offsets in words.pieces(batch.column(1)):
            text, feature = features(data, offsets)
            both = np.unique((text << BITS) | feature)
            cuts = np.searchsorted(both >> BITS, np.arange(j - i + 1))
            both = (both & ((1 << BITS) - 1)).astype(np.int32)
            lists += [_some(both[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([grades, pa.array(lists, pa.list_(pa.int32()))], ["grade", "features"])


def _some(features: np.ndarray) -> np.ndarray:
    """The PER_TEXT features of least hash, so that texts keep the same ones."""
    if len(features) <= PER_TEXT:
        return features
    return np.sort(features[np.argpartition(words.mix(features.astype(np.uint64) + np.uint64(1)), PER_TEXT)[:PER_TEXT]])


def train(docs: DataFrame, graded: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> Model:
    """A model from `graded` (doc_id, grade 0 .. n_grades - 1) and the texts of at most `per_grade` rows of each grade.

    The sample of a grade is its ids with the smallest hash, and of documents that share an id the text that is
    least, so what reaches the driver is bounded by n_grades * per_grade * PER_TEXT features. Null ids, grades and
    texts and grades other than 0 .. n_grades - 1 (fractions too) are left out; an id that is labelled more than
    once has its highest grade. Without any labelled row the model gives severity near 0.
    """
    whole = F.col("grade").isin(*range(n_grades))
    graded = graded.where(F.col("doc_id").isNotNull() & whole).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    shares = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per grade
    parts = [graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade) for g in sorted(shares)]
    if not parts:
        return Model(np.zeros(1 << BITS, np.float32), np.full(n_grades - 1, 10.0))
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    sample = sample.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("_grade"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where("_text is not null").join(
        F.broadcast(sample), F.col("_doc") == F.col("_id"))  # at most n_grades * per_grade ids
    rows = rows.groupBy("_id").agg(F.max("_grade").alias("_grade"), F.min("_text").alias("_text")).select("_grade", "_text")
    table = rows.mapInArrow(_listed, "grade int, features array<int>").toArrow()
    grades = table["grade"].to_numpy()
    lists = [x for c in table["features"].chunks if len(c) for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]
    got = np.bincount(grades, minlength=n_grades) if len(grades) else np.zeros(n_grades)
    if not len(grades):
        return Model(np.zeros(1 << BITS, np.float32), np.full(n_grades - 1, 10.0))
    weight = np.array([shares[g] / got[g] for g in grades.tolist()])
    return fit(lists, grades.astype(np.int64), weight, n_grades)


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for i, j, data, offsets in words.pieces(column):
        text, feature = features(data, offsets)
        live = model.weights[feature] != 0
        both = np.unique((text[live] << BITS) | feature[live])
        out.append(np.bincount(both >> BITS, model.weights[both & ((1 << BITS) - 1)].astype(float), j - i))
    return np.concatenate(out)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, severity (expected grade), grade (most probable), toxic (P(top grade) >= 1/2).

    A null or empty text has no features, so it gets the grades' base rates. Ids are passed on,
    null and repeated ones too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = shared.value.probabilities(_scores(shared.value, batch.column(1)))
            bounds = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
            grade = np.argmax(bounds[:, :-1] - bounds[:, 1:], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade), pa.array(above[:, -1] >= 0.5)], ["doc_id", "severity", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = shared.value.probabilities(_scores(shared.value, batch.column(at)))
            yield batch.filter(pa.array(above[:, -1] < 0.5))

    return docs.mapInArrow(run, docs.schema)
