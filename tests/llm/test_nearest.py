"""Nearest vectors against brute force: recall, scores, ties and vectors that take no part."""

from collections import defaultdict

import numpy as np
import pytest

from mereling.llm import nearest, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, block int, asks int, score double, rank int"


def make(spark, rows):
    """Vectors with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "v", 3, 4, 0.5, 6) for i, v in rows], SCHEMA)


def brute(rows, dimension, k=20):
    """{query: [(vec_id, score)]} of all candidates, best first; the vectors as floats."""
    whole = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == dimension and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q in sorted({i for i, _ in whole if i % 20 == 0}):
        asks = min((v.tolist() for i, v in whole if i == q))
        out[q] = sorted(((i, float((v * asks).sum())) for i, v in whole if i != q), key=lambda x: (-x[1], x[0]))
    return out


def recall(df, rows, dimension, k=20):
    """Of what brute force gives, the share found; all else about the rows is checked."""
    got, want = defaultdict(list), brute(rows, dimension)
    for r in df.collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {q for q, all_ in want.items() if all_}
    hit = total = 0
    for q, all_ in want.items():
        own, scores = sorted(got[q]), defaultdict(list)
        assert [r for r, _, _ in own] == list(range(1, min(k, len(all_)) + 1))
        for i, s in all_:
            scores[i].append(s)
        assert all(any(abs(s - x) <= 1e-12 * max(1, abs(x)) for x in scores[i]) for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        last = all_[: k][-1][1] if all_ else 0
        hit, total = hit + sum(s >= last - 1e-12 for _, _, s in own), total + len(own)
    return hit / total


def rows_of(kind, n, d, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "clusters":
        x = r.standard_normal((30, d))[r.integers(0, 30, n)] + 0.05 * x
    if kind == "norms":
        x *= r.lognormal(0, 1.5, n)[:, None]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["unit", "clusters", "norms"])
@pytest.mark.parametrize("block", [700, 1 << 14])
def test_recall(spark, kind, block):
    rows = rows_of(kind, 2000, 48)
    df = make(spark, rows).repartition(5)
    assert recall(nearest.nearest(df, df.where("vec_id % 20 = 0"), block=block), rows, 48) >= 0.95


def test_query_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in t]
    assert recall(queries.op11_nearest(spark, "/root/testdata/sf0.1"), rows, 64) >= 0.95


def test_odd_rows(spark, tmp_path):
    """Nulls, zeros, other dimensions, copies and repeated ids; fewer candidates than k."""
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [0, 0]), (3, None), (None, [1, 1]), (4, [1, None]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, [1, 2, 3]), (8, []), (20, [0, 1]), (20, [3, 1]), (20, [3, 1]), (9, [-1, -1]), (40, [0, 0]), (60, [1, 2, 3]), (-20, [1e-30, 1e-30])]
    make(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert recall(queries.op11_nearest(spark, str(tmp_path)), rows, 2) == 1


def test_many_copies(spark):
    """A third of all rows is one vector, of another third all share an id: ties go to the smaller ids."""
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(1000)] + [(5000, [0.0, 0.6, 0.8])] * 1000 + rows_of("unit", 1000, 3)[1:]
    df = make(spark, rows).repartition(4)
    asks = make(spark, [(5000, [0.0, 0.6, 0.8]), (20, [0.6, 0.8, 0.0])])
    got = defaultdict(list)
    for r in nearest.nearest(df, asks, block=500).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[20] == list(range(20))
    assert len(got[5000]) == 20 and 5000 not in got[5000]


def test_counts_and_threshold():
    """The collisions counted from sorted arrays are those of the windows; the threshold holds its promise."""
    rows = rows_of("unit", 800, 16)
    index = nearest.Index(np.arange(800), np.array([v for _, v in rows]), 1.0)
    for q in (0, 20, 40):
        ids, scores, verified = index.search(q, np.array(rows[q][1]), 20)
        assert len(ids) == 20 and q not in ids and 20 <= verified < 800
    r = np.random.default_rng(1)
    near = (np.abs(r.standard_normal((20_000, nearest.M))) <= nearest.WIDTH).sum(axis=1)
    assert 1 - nearest.MISS - 0.01 <= (near >= nearest.threshold(nearest.M, nearest.WIDTH, nearest.MISS)).mean() <= 1


def test_empty(spark):
    df = make(spark, [])
    assert nearest.nearest(df, df).count() == 0
    assert nearest.nearest(make(spark, [(1, [1.0])]), df).count() == 0
    one = make(spark, [(20, [1.0])])
    assert nearest.nearest(one, one).count() == 0
