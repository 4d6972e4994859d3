import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mereling.llm import components, near_dedup as N
from tests.llm.conftest import make, words


def shingles(text):
    w = [x for x in re.split("[ \t\n\v\f\r]+", text or "") if x]
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """The least id of each row's class, over all pairs of distinct texts."""
    texts = list({t or "" for _, t in rows})
    bags = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, b in enumerate(bags):
        for j in {j for g in b for j in index[g]}:
            if sum((b & bags[j]).values()) >= threshold * sum((b | bags[j]).values()):
                parent[find(i)] = find(j)
        for g in b:
            index[g].add(i)
    at = {t: find(i) for i, t in enumerate(texts)}
    ids = defaultdict(list)
    for i, t in rows:
        ids[at[t or ""]].append(i)
    return sorted(((i, min((x for x in ids[at[t or ""]] if x is not None), default=None), len(ids[at[t or ""]])) for i, t in rows), key=repr)


def edited(seed, text, n):
    r = random.Random(seed)
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = words(seed * 1000 + k, 1)
    return " ".join(w)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "class_size").collect()), key=repr)


def test_signature_is_unbiased():
    r = np.random.default_rng(1)
    for _ in range(5):
        u, a = r.integers(0, 2**63, 80, dtype=np.uint64), r.integers(0, 12, 80)
        b = np.where(r.random(80) < 0.7, a, r.integers(0, 12, 80))
        own = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = N.signatures(own, np.concatenate([u[a > 0], u[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.035)


def test_groups(spark):
    rows = []
    for g in range(12):
        base = words(g, 60 + 20 * g)
        rows += [(g * 100 + k, edited(g * 50 + k, base, k % 4) if k else base) for k in range(7)]
    rows += [(5000 + i, words(900 + i, 40)) for i in range(60)] + [(6000, "a b " * 60), (6001, "a b " * 61), (6002, "a b " * 90)]
    assert got(N.near_duplicates(make(spark, rows))) == brute(rows)


def test_large_group_of_all_degrees(spark):
    """A star doesn't link all that belongs together in such a group; the exact comparison does."""
    base = words(3, 150)
    rows = [(i, edited(i, base, 3)) for i in range(80)] + [(200 + i, edited(i, base, 12)) for i in range(20)] + [(500 + i, words(i, 50)) for i in range(30)]
    chain = [base]
    for k in range(25):  # each a link from the last, not from the others
        chain.append(edited(90 + k, chain[-1], 3))
    rows += [(700 + k, t) for k, t in enumerate(chain)]
    assert got(N.near_duplicates(make(spark, rows))) == brute(rows)


def test_drop_and_edges(spark, edge, edge_rows, empty):
    assert got(N.near_duplicates(edge)) == brute(edge_rows)
    kept = N.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in brute(edge_rows)}
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_one_row_of_each_class_stays(spark):
    def near(seed, at):
        w = words(seed, 120).split()
        return " ".join(w[:at] + ["changed"] + w[at + 1 :])

    rows = [(None, near(1, k)) for k in (10, 60, 110)] + [(None, near(1, 10))]  # no other id
    rows += [(None, near(2, 60)), (3, near(2, 10)), (4, words(2, 120))]  # null gives way
    rows += [(7, near(4, 60)), (7, words(4, 120))]  # an id of two texts in one class
    rows += [(8, words(5, 120)), (8, words(6, 120)), (5, near(6, 60))]  # and in two classes, kept in one
    rows += [(9, words(7, 120))] * 3
    df = make(spark, rows)
    flagged = [r for r in N.near_duplicates(df).collect() if r.kept]
    ids = [repr(r.doc_id) for r in flagged]
    assert sorted(set(ids)) == ["3", "5", "7", "8", "9", "None"] and ids.count("7") == ids.count("8") == 1 and ids.count("9") == 3
    assert ids.count("None") <= 2  # the kept text may be the one that is there twice
    kept = N.drop_near_duplicates(df)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns and sorted(repr(i) for i, _ in got) == ["3", "5", "7", "8", "9", "None"]
    assert (8, words(5, 120)) in got and (3, near(2, 10)) in got and set(got) <= set(rows)


def test_links_carry_their_overlap(spark):
    base = words(11, 100)
    near, far = edited(1, base, 2), words(12, 100)
    rows = {r.doc_id: r for r in N.near_duplicates(make(spark, [(1, base), (2, near), (3, far), (4, base), (5, None)])).collect()}
    a, b = shingles(base), shingles(near)
    want = sum((a & b).values()) / sum((a | b).values())
    assert [rows[i].n_links for i in range(1, 6)] == [1, 1, 0, 1, 0] and rows[3].similarity is None
    assert all(rows[i].similarity == pytest.approx(want) for i in (1, 2, 4))


def test_planted_copies_of_the_tables_against_all_pairs(spark):
    """All links at the contract's similarity are found: the classes are those of comparing all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert got(N.near_duplicates(docs)) == want and sum(n > 1 for _, _, n in want) > 100


def test_very_long_near_copies_have_a_linear_prefix_table(spark, tmp_path):
    """Pairs just under and over the threshold; no row of the prefix table grows with the text."""
    rows = []
    for k, n in enumerate((1000, 100_000)):
        text = words(40 + k, n)
        rows += [(10 * k, text), (10 * k + 1, edited(k, text, int(n * 0.021))), (10 * k + 2, edited(k + 7, text, int(n * 0.03)))]
    assert got(N.near_duplicates(make(spark, rows))) == brute(rows)
    # the exact comparison alone, all texts being components of their own
    lists = spark.createDataFrame(rows, "id long, text string").selectExpr("unhex(md5(text)) as node", "text").mapInArrow(N._listed, "node binary, shingles array<long>")
    links = N._links_across(lists.withColumn("component", lists["node"]), lists, 0.8).collect()
    bags = [shingles(t) for _, t in rows]
    want = [sum((a & b).values()) / sum((a | b).values()) for i, a in enumerate(bags) for b in bags[:i]]
    assert sorted(r.similarity for r in links) == pytest.approx(sorted(x for x in want if x >= 0.8))


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (2000, 2000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {x: find(x) for x in parent} and len(rows) == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
