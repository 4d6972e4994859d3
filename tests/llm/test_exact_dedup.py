import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from mereling.llm import exact_dedup
from tests.llm.conftest import make


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        k = keep(ids) if ids else None
        out.append((i, k, len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_groups(edge, edge_rows):
    assert got(exact_dedup.exact_groups(edge)) == brute(edge_rows, min)
    assert got(exact_dedup.exact_groups(edge, keep="largest")) == brute(edge_rows, max)


def test_collisions_are_excluded(edge, edge_rows):
    bad = lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)
    assert got(exact_dedup.exact_groups(edge, hash_text=bad)) == brute(edge_rows, min)


def test_normalise(spark):
    df = make(spark, [(1, "A b"), (2, "a B")])
    assert {r.keep_id for r in exact_dedup.exact_groups(df, normalise=F.lower).collect()} == {1}


def test_drop_copies(edge, edge_rows):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted({min(i for i, u in edge_rows if (u or "") == (t or "") and i is not None) for _, t in edge_rows}, key=repr)
    assert max(r.doc_id for r in exact_dedup.drop_copies(edge, keep="largest").collect()) == 12


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
