import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, k1 string, h string, places string, _text string, _hash string, _row string, kept string, bands string, _keep string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def make(spark, rows):
    """Documents (id, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, None, 7, "n", "k", "h", "p", "x", None, "r", "no", "b", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows and ids, near copies."""
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (None, base), (None, None), (4, None), (5, ""), (6, "   \n\t "), (7, words(2, 30_000)), (8, "short text"), (9, "short text"),
        (10, words(3, 50) + " " + " ".join(base.split()[20:70])), (11, "ünï ▁ código \x00 😀 ​"), (12, words(4, 40)),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return make(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
