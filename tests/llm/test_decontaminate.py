import random

import numpy as np
import pytest

from mereling.llm import decontaminate as D
from tests.llm.conftest import make, words


def slow_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1)), 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] - D.GAP, h[i, j - 1] - D.GAP)
            best = max(best, h[i, j])
    return best


def test_alignment():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 25)).astype(np.uint64), r.integers(0, 5, r.integers(0, 40)).astype(np.uint64)
        assert D.align(a, b)[0] == pytest.approx(slow_align(a, b))


def cases():
    r = random.Random(2)
    items = [(k, words(1000 + k, 30)) for k in range(6)] + [(6, None), (7, ""), (8, "two words"), (9, words(1000, 30))]
    docs = []
    for i in range(200):
        body = words(i, 80).split()
        kind, item = i % 8, items[i % 6][1].split()
        if kind == 0:
            part = item
        elif kind == 1:  # every sixth word is another
            part = [w if k % 6 else words(i * 100 + k, 1) for k, w in enumerate(item)]
        elif kind == 2:  # words left out and put in
            part = [x for k, w in enumerate(item) if k % 9 != 4 for x in ([w, "new"] if k % 7 == 3 else [w])]
        elif kind == 3:  # a short phrase only
            part = item[5:12]
        else:
            part = []
        at = r.randrange(80)
        text = " ".join(body[:at] + part + body[at:])
        docs.append((i, text.upper().replace(" ", ", ", 5) if i % 3 == 0 else text))
    return items, docs


def brute(items, docs):
    import re

    tok = lambda t: np.array([hash(w) & 0xFFFFFFFFFFFF for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())], np.uint64)
    found = set()
    for i, t in docs:
        for k, u in items:
            a = tok(u)
            if len(a) >= D.N and D.align(a, tok(t))[0] / (D.MATCH * len(a)) >= D.SCORE:
                found.add((i, k))
            if 0 < len(a) < D.N and any((tok(t)[p : p + len(a)] == a).all() for p in range(len(tok(t)) - len(a) + 1)):
                found.add((i, k))
    return found


def test_against_aligning_all_pairs(spark):
    items, docs = cases()
    table = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    df = make(spark, docs)
    got = D.matches(df, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(items, docs) and len(got) == len(brute(items, docs))
    assert {r.doc_id for r in got} == {i for i, _ in docs if i % 8 < 3}
    clean = D.drop_contaminated(df, table)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs if i % 8 >= 3}


@pytest.mark.parametrize("passage", [None, D.PASSAGE])
def test_dense_edits_and_torn_items(spark, passage):
    """Every second to sixth word changed, words put in up to the item's length, and an item in two parts: all that reach the score are found."""
    r = random.Random(4)
    items = [(k, words(300 + k, n)) for k, n in enumerate([3, 4, 5, 9, 20, 30, 54, 100])]
    common = words(999, 12).split()
    items += [(20, " ".join(r.choice(common) for _ in range(40))), (21, " ".join(r.choice(common) for _ in range(15)))]
    docs = []
    for k, u in items:
        w = u.split()
        for step in range(2, 7):
            for shift in range(step):
                docs.append([x if (i + shift) % step else words(7000 + i + shift, 1) for i, x in enumerate(w)])
                docs.append([x for i, x in enumerate(w) if (i + shift) % step])
        for n in (len(w) // 2, len(w) - 1, len(w), len(w) + 3):
            own = list(w)
            for _ in range(n):
                own.insert(r.randrange(1, len(own)) if len(own) > 1 else 0, words(r.randrange(9999), 1))
            docs.append(own)
            docs.append([y for i, x in enumerate(w) for y in ([x] if i >= n else [x, words(8000 + i, 1)])])
            docs.append(w[: len(w) // 2] + words(r.randrange(9999), n).split() + w[len(w) // 2 :])
        docs.append(w[: len(w) * 4 // 9] + words(5, 40).split() + w[len(w) - len(w) * 4 // 9 :])
    docs = [(i, " ".join(words(40_000 + i, 30).split() + d + words(50_000 + i, 30).split())) for i, d in enumerate(docs)]
    want = brute(items, docs)
    got = D.matches(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"), passage=passage).collect()
    assert len(want) > 250
    assert {(x.doc_id, x.item_id) for x in got if x.score >= D.SCORE} == want


def test_the_edits_that_hide_every_run(spark):
    """A third of 30 words changed leaves no run of three; an item in two parts around 40 words: both reach the score."""
    whole, torn = words(1, 30).split(), words(2, 54).split()
    docs = [(1, " ".join(w if k % 3 != 1 else f"x{k}" for k, w in enumerate(whole))), (2, " ".join(torn[:24] + words(3, 40).split() + torn[30:]))]
    items = [(1, " ".join(whole)), (2, " ".join(torn))]
    got = {(r.doc_id, r.item_id): r.score for r in D.matches(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"), passage=D.PASSAGE).collect()}
    assert set(got) == brute(items, docs) == {(1, 1), (2, 2)}


def test_blocks_make_no_difference(spark):
    items, docs = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    df = make(spark, docs[:60])
    each = list(D.blocks(df, table, block=50))
    assert len(each) == 7 and 8 in each[-2].ids + each[-1].ids
    import pyarrow as pa

    column = pa.array([t for _, t in docs[:60]])
    many = {(docs[row][0], b.ids[k]) for b in each for row, k, _, _ in D.search(b, column)}
    assert many == {(r.doc_id, r.item_id) for r in D.matches(df, table).collect()}


def test_an_item_all_over_the_corpus_is_still_found(spark):
    item = words(77, 25)
    docs = make(spark, [(i, words(i, 5) + " " + item) for i in range(60)] + [(100 + i, words(5000 + i, 30)) for i in range(120)])
    got = D.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(60))


def test_edited_copies_of_hot_and_common_items(spark):
    hot, filler = words(77, 25).split(), words(78, 6).split()
    common = [filler[k * k % 6] for k in range(12)]
    items = [(1, " ".join(hot)), (2, " ".join(common))]
    docs = []
    for i in range(75):  # one word is another, at each place in turn
        docs.append((i, words(i, 5) + " " + " ".join(w if k != i % 25 else "other" for k, w in enumerate(hot))))
        docs.append((100 + i, words(500 + i, 5) + " " + " ".join(w if k != i % 12 else "other" for k, w in enumerate(common))))
        docs.append((200 + i, words(5000 + i, 30) + " " + filler[i % 6]))
    got = D.matches(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(items, docs)
    assert {(i, 1) for i in range(75)} | {(100 + i, 2) for i in range(75)} <= want
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_passages_of_long_items(spark, monkeypatch):
    item = words(90, 500)
    w, r = item.split(), random.Random(5)
    docs, want = [], set()
    for i in range(120):
        size = [200, 60, 40, 25, 24, 12][i % 6]
        at = r.randrange(500 - size)
        part = w[at : at + size]
        if i % 6 == 1:  # every sixth word is another
            part = [x if k % 6 else words(i * 100 + k, 1) for k, x in enumerate(part, 1)]
        if i % 6 == 2:  # put in and left out, 12 matches apart
            part = part[:13] + ["new"] + part[13:26] + part[27:]
        docs.append((i, " ".join(words(1000 + i, 40).split() + part + words(3000 + i, 40).split())))
        tokens = np.array([hash(x) & 0xFFFFFFFFFFFF for x in docs[-1][1].split()], np.uint64)
        if D.align(np.array([hash(x) & 0xFFFFFFFFFFFF for x in w], np.uint64), tokens, -D.EDIT, D.EDIT)[0] >= D.MATCH * D.PASSAGE:
            want.add(i)
    assert {i for i in range(120) if i % 6 in (0, 1, 2, 3)} <= want and not {i for i in range(120) if i % 6 == 5} & want
    df, items = make(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = D.matches(df, items, passage=D.PASSAGE).collect()
    assert {x.doc_id for x in got} == want and len(got) == len(want) and all(x.score < D.SCORE for x in got)
    assert {x.doc_id for x in D.drop_contaminated(df, items, passage=D.PASSAGE).collect()} == set(range(120)) - want
    import pyarrow as pa

    block = next(D.blocks(df, items, passage=D.PASSAGE))
    for part in (7, 40):  # hits of a text in several parts
        monkeypatch.setattr(D, "_PART", part)
        assert {row for row, *_ in D.search(block, pa.array([t for _, t in docs[:12]]), passage=D.PASSAGE)} == {i for i in want if i < 12}


def test_queries_find_passages(spark, tmp_path):
    import corpus_pipeline
    from mereling.llm import queries

    make(spark, [(1, words(5, 50) + " " + " ".join(words(90, 500).split()[100:300])), (2, words(6, 200))]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(90, 500))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in queries.op1_decontaminate(spark, str(tmp_path)).collect()] == [1]
    kept = corpus_pipeline.drop_leaks(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_items_too_short_for_a_seed_match_as_a_whole(spark):
    items = spark.createDataFrame([(1, "Foo barbaz"), (2, "qux"), (3, "foo  BARBAZ"), (4, "..."), (5, "foo qux barbaz")], "item_id int, text string")
    docs = [(1, "x foo barbaz qux"), (2, "foo, barbaz"), (3, "foo x barbaz"), (4, None), (5, "fooo barbaz"), (6, "")]
    got = D.matches(make(spark, docs), items)
    assert dict(got.dtypes)["item_id"] == "int"
    rows = sorted((r.doc_id, r.item_id, r.score, r.end_token) for r in got.where("item_id <> 5").collect())
    assert rows == [(1, 1, 1.0, 3), (1, 2, 1.0, 4), (1, 3, 1.0, 3), (2, 1, 1.0, 2), (2, 3, 1.0, 2)]
    assert sorted(r.doc_id for r in D.drop_contaminated(make(spark, docs), items.where("item_id <> 5")).collect()) == [3, 4, 5, 6]
    for kind in ("short", "string", "decimal(10,0)"):
        again = D.matches(make(spark, docs), items.withColumn("item_id", items["item_id"].cast(kind))).where("item_id <> 5")
        assert sorted((r.doc_id, int(r.item_id)) for r in again.collect()) == [x[:2] for x in rows]


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, words(1, 120)), (None, words(2, 30))], "item_id long, text string")
    rows = D.matches(edge, items).collect()
    assert sorted((repr(r.doc_id), repr(r.item_id)) for r in rows) == sorted([("1", "1"), ("2", "1"), ("2", "1"), ("3", "1"), ("None", "1"), ("7", "None")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(edge, none).count() == 0 and D.matches(empty, items).count() == 0
    assert D.drop_contaminated(edge, none).count() == 15 and D.drop_contaminated(empty, items).count() == 0
