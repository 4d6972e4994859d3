import random
import re

import numpy as np
from pyspark.sql import functions as F

from mereling.llm import toxicity as X
from mereling.llm import words as W
from tests.llm.conftest import make, words

BAD = ["vilify", "lostraxy", "scumbag"]


def corpus(n=3000):
    r = random.Random(5)
    texts, grades = [], []
    for i in range(n):
        g = 2 if i % 6 == 0 else 1 if i % 6 == 1 else 0
        w = ["the of and to in a is it that for".split()[r.randrange(10)] if r.random() < 0.7 else words(r.randrange(400), 1) for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(1, 4) if g else 0):
            w.insert(r.randrange(len(w)), (r.choice(BAD) + ("" if r.random() < 0.5 else words(i, 1))) if g == 2 else r.choice(["$$$spam", "clickz"]))
        texts.append(" ".join(w))
        grades.append(g)
    return texts, grades


def test_held_out_accuracy(spark):
    texts, grades = corpus()
    docs = make(spark, list(enumerate(texts)))
    graded = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 7] + [(None, 1), (3, None)], "doc_id long, grade int")
    model = X.train(docs, graded, 3)
    assert model.thresholds[0] <= model.thresholds[1]
    rows = {r.doc_id: r for r in X.predict(docs, model).collect()}
    held = [i for i in range(len(texts)) if i % 7 < 1]
    assert np.mean([rows[i].toxic == (grades[i] == 2) for i in held]) > 0.97
    severity = [np.mean([rows[i].severity for i in held if grades[i] == g]) for g in range(3)]
    assert severity[0] < severity[1] < severity[2]
    assert np.mean([rows[i].toxic for i in held if grades[i] == 2]) > 0.9
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in rows if not rows[i].toxic}


def test_probabilities_add_up():
    m = X.Model(np.zeros(1 << X.BITS, np.float32), np.array([-1.0, 0.5]))
    p = m.probabilities(np.array([-3.0, 0.0, 3.0]))
    assert (p[:, 0] >= p[:, 1]).all() and (np.diff(p[:, 0]) > 0).all()


def slow_features(text):
    """The features of one text, token by token."""
    out = set()
    for token in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))):
        data = np.frombuffer(token, np.uint8)
        for n in (0, *X.PREFIXES):
            if n < len(token):
                h = W.hashes(data, np.array([0]), np.array([n or len(token)]), n)[0]
                out.add(int(h) >> (64 - X.BITS))
    return out


def test_scores_against_one_text_at_a_time(spark, edge, edge_rows):
    r = np.random.default_rng(4)
    model = X.Model(np.where(r.random(1 << X.BITS) < 0.3, r.normal(0, 0.5, 1 << X.BITS), 0).astype(np.float32), np.array([-0.5, 1.0]))
    got = sorted((repr(x.doc_id), round(x.severity, 6), x.grade, x.toxic) for x in X.predict(edge, model).collect())
    want = []
    for i, text in edge_rows:
        score = sum(float(model.weights[f]) for f in slow_features(text))
        p1, p2 = (1 / (1 + np.exp(-np.clip(score - t, -50, 50))) for t in model.thresholds)
        want.append((repr(i), round(float(p1 + p2), 6), int(np.argmax([1 - p1, p1 - p2, p2])), bool(p2 >= 0.5)))
    assert got == sorted(want)


def test_fit_finds_the_best_of_the_penalised_likelihood():
    """Against a search over single weights and thresholds around the result."""
    r = np.random.default_rng(2)
    rows = [np.array([0, *(1 + np.flatnonzero(r.random(3) < 0.4))]) for _ in range(400)]
    grades = np.array([int(np.clip((2 in x) + (3 in x) + (r.random() < 0.15), 0, 2)) for x in rows])
    weight = np.ones(400)
    m = X.fit(rows, grades, weight, 3, steps=3000)

    def loss(w, theta):
        score = np.array([w[x].sum() for x in rows])
        above = np.concatenate((np.ones((400, 1)), 1 / (1 + np.exp(-(score[:, None] - theta))), np.zeros((400, 1))), axis=1)
        p = above[np.arange(400), grades] - above[np.arange(400), grades + 1]
        return -np.log(p).mean() + 1e-3 * np.abs(w[:4]).sum()

    best = loss(m.weights.astype(float), m.thresholds)
    for k in range(4):
        for d in (-0.05, 0.05):
            w = m.weights.astype(float)
            w[k] += d
            assert loss(w, m.thresholds) > best - 1e-5
    for k in range(2):
        for d in (-0.05, 0.05):
            theta = m.thresholds.copy()
            theta[k] += d
            assert loss(m.weights.astype(float), theta) > best - 1e-5


def test_odd_labels_and_bounded_sample(spark, edge, monkeypatch):
    odd = spark.createDataFrame([(1, 0), (1, 2), (2, 7), (3, -1), (7, 1), (12, 0)], "doc_id long, grade int")
    same = spark.createDataFrame([(1, 2), (7, 1), (12, 0)], "doc_id long, grade int")
    a, b = X.train(edge, odd, 3), X.train(edge, same, 3)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    monkeypatch.setattr(X, "PER_TEXT", 100)
    some = X._some(np.arange(5000, dtype=np.int32))
    assert len(some) == 100 and (np.diff(some) > 0).all() and set(X._some(some[:99])) == set(some[:99])


def test_documents_that_share_an_id_and_fractional_grades(spark, monkeypatch):
    """However many documents share a labelled id, one of them reaches the driver; a grade of 1.5 is none."""
    seen = []
    fit = X.fit
    monkeypatch.setattr(X, "fit", lambda lists, *rest: (seen.append(len(lists)), fit(lists, *rest))[1])
    docs = spark.range(20_000).selectExpr("cast(case when id < 19998 then 5 else id end as long) as doc_id", "concat('some text ', cast(id % 7 as string)) as text")
    grades = spark.createDataFrame([(5, 2.0), (19_998, 0.0), (19_999, 1.5)], "doc_id long, grade double")
    X.train(docs, grades, 3)
    assert seen == [2]


def test_edges(spark, edge, empty):
    no_labels = spark.createDataFrame([], "doc_id long, grade int")
    model = X.train(edge, no_labels, 3)
    rows = X.predict(edge, model).collect()
    assert len(rows) == 15 and not any(r.toxic for r in rows)
    assert X.drop_toxic(edge, model).count() == 15
    model = X.train(edge, spark.createDataFrame([(1, 0), (2, 2), (4, 1)], "doc_id long, grade int"), 3)
    assert X.predict(edge, model).count() == 15 and X.predict(empty, model).count() == 0
    assert X.train(empty, spark.createDataFrame([(1, 0)], "doc_id long, grade int"), 3).thresholds.shape == (2,)
    assert edge.where(F.col("text").isNull()).count() == 2
