import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from mereling.llm import substring_dedup as S
from mereling.llm import words as W
from tests.llm.conftest import make, words


def brute(rows, w=35):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(t[i : i + w]) for t in texts for i in range(len(t) - w + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(t) - w + 1):
            if count[tuple(t[k : k + w])] > 1:
                gone |= set(range(k, k + w))
        kept = " ".join(x for k, x in enumerate(t) if k not in gone)
        out.append((i, len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, S.remove_repeats(df, digest=True).collect()), key=repr)


def cases():
    r = random.Random(8)
    passages = [words(100 + k, 30 + 5 * k) for k in range(8)]  # 30 to 65 words
    rows = []
    for i in range(150):
        parts = [words(i, r.randint(1, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages).split()
            a, b = (0, len(p)) if r.random() < 0.6 else sorted((r.randrange(len(p)), r.randrange(len(p))))
            parts += [" ".join(p[a:b]), words(i * 7 + len(parts), r.randint(0, 30))]
        rows.append((i, r.choice([" ", "\n", "\t ", "\r\n"]).join(parts)))
    rows += [(500, "same " * 100), (501, "same " * 34), (502, "same " * 35), (503, "ab cd " * 40), (504, words(1, 60) + " " + words(1, 60))]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    df = make(spark, rows).repartition(7)
    assert got(df) == brute(rows)
    kept = {r.doc_id: r.text for r in S.remove_repeats(df).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()} == {x[0]: x[3] for x in brute(rows)}


def test_copies_of_a_hot_text(spark):
    text = words(5, 300)
    rows = [(None, text)] * 60 + [(1, text)] * 30 + [(i, words(10 + i, 50)) for i in range(2, 6)]
    assert got(make(spark, rows).repartition(6)) == brute(rows)


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_long_words_that_sums_of_powers_confuse(spark):
    for n in (1024, 2048, 4096):
        one, other = thue_morse(n)
        rows = [(1, f"{words(1, 40)} {one}"), (2, f"{words(1, 40)} {other}")]
        assert [r[2] for r in got(make(spark, rows))] == [40, 40]
        assert got(make(spark, rows)) == brute(rows)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("x", words(1, 50)), ("y", words(1, 50)), (None, words(2, 50))], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_removed) for r in S.remove_repeats(df).collect()) == [("", 0), ("x", 50), ("y", 50)]


def _run(rows, phrases):
    """_windows on one pack that was sent `phrases`: the places of its confirmed or counted windows."""
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
    (pack,) = S._packed(iter([batch]))
    sent = pa.RecordBatch.from_arrays([pack.column(0), pack.column(1), pa.array([phrases], pa.list_(pa.binary()))], ["pack", "data", "sent"])
    places = set()
    for out in S._windows(iter([sent])):
        for runs in out.column("runs").to_pylist():
            for at, n in np.frombuffer(runs, np.int32).reshape(-1, 2).tolist():
                places |= set(range(at, at + n))
    return places, pack


def test_only_the_automaton_says_where_windows_recur(spark, monkeypatch):
    rows = cases()
    df = make(spark, rows)
    small = [(1, words(1, 60) + " " + words(2, 40)), (2, words(3, 20) + " " + words(1, 60))]
    _, pack = _run(small, [])
    (sent,) = S._phrases(iter([pack]))
    all_of_them = [S.DONE + h.to_bytes(8, "big", signed=True) + p for p, h in zip(sent.column("phrase").to_pylist(), sent.column("passage").to_pylist(), strict=True)]
    every, _ = _run(small, all_of_them)
    n = [len(t.split()) for _, t in small]
    assert every == set(range(n[0] - 34)) | set(range(n[0], n[0] + n[1] - 34))
    nothing, _ = _run(small, [])
    assert nothing == set()
    some, _ = _run(small, all_of_them[:1])
    assert some and some < every
    # a phrase sent by another pack is found here wherever it stands, at all of its places
    twice, _ = _run([(1, words(7, 30) + " " + words(1, 60)), (2, words(1, 60))], all_of_them)
    assert {90, 30} <= twice
    # with an automaton that finds nothing, nothing is removed
    assert any(r[2] for r in got(df))
    packs = S._packed(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([words(1, 60)])], ["id", "text"])]))
    monkeypatch.setattr(S.Phrases, "occurrences", lambda self, *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    batch = next(packs)
    out = list(S._windows(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([all_of_them], pa.list_(pa.binary()))], ["pack", "data", "phrases"])])))
    assert sum(o.num_rows for o in out) == 0


def test_edges(edge, edge_rows, empty):
    assert got(edge) == brute(edge_rows)
    assert got(empty) == []


def test_many_equal_rows_without_an_id(spark):
    """Packs of equal rows have numbers of their own: what they say grows with the rows, not with their square."""
    text, size = words(3, 200), []
    for n in (8000, 16_000):
        df = make(spark, [(None, text)]).select("doc_id", "text").crossJoin(spark.range(0, n, 1, 2).select()).select("doc_id", "text")
        rows = S.confirmed(df).selectExpr("pack", "aggregate(runs, 0L, (t, r) -> t + length(r)) as bytes").collect()
        assert len({r["pack"] for r in rows}) == len(rows) > 3
        size.append(sum(r["bytes"] or 0 for r in rows))
    assert size[1] < 2.3 * size[0]


def test_equal_windows_have_equal_seeds():
    r = np.random.default_rng(0)
    tokens = np.concatenate([r.integers(0, 2**63, 50, dtype=np.uint64), (p := r.integers(0, 2**63, 60, dtype=np.uint64)), r.integers(0, 2**63, 9, dtype=np.uint64), p])
    starts, place = S.seeds(tokens, np.array([0, len(tokens)]))
    assert len(starts) == len(tokens) - S.W + 1
    assert (place[50:76] - starts[50:76] == place[119:145] - starts[119:145]).all()


def test_automaton_finds_every_occurrence():
    texts = ["a b c d e f g h i a b c d e f g h h", "x a b c d e f g", "h a b c d e f g h a b c d e f g h"]
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, ends, first = W.split(raw, offsets)
    for base in (S._DIGIT, 4):  # one digit a word, then two
        S._DIGIT, before = base, S._DIGIT
        try:
            at, values = S.Phrases([b"h a b c d e f g", b"a b c d e f g h"]).occurrences(raw, starts, ends, first)
        finally:
            S._DIGIT = before
        assert sorted(zip(at.tolist(), values.tolist(), strict=True)) == [(0, 1), (9, 1), (26, 0), (27, 1), (34, 0), (35, 1)]


def test_a_run_of_more_places_than_24_bits_can_count():
    runs = np.array([[5, (1 << 24) + 3]], np.int64)
    n = (1 << 24) + 100
    raw = np.full(2 * n, 0x20, np.uint8)
    raw[::2] = 0x61
    starts = np.arange(n) * 2
    ((total, removed, kept),) = S._kept(raw, starts, starts + 1, np.array([0, n]), runs)
    assert (total, removed, len(kept)) == (n, (1 << 24) + 3 + 34, 2 * (n - (1 << 24) - 37) - 1)
