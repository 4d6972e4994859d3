"""Alignment against the libraries on whole texts and a plain comparison of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mereling.llm import queries, token_alignment
from tests.llm.conftest import make, words

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    signs = token_alignment.byte_signs()
    return a, b, lambda i: bytes(signs[c] for c in a.id_to_token(i)), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of(i)), i))
        at += len(of(i))
    return out


def aligned(text, libraries):
    """(A tokens, B tokens, groups, links) of one text, by whole-text encoding."""
    a, b, a_bytes, b_bytes = libraries
    if not text:
        return [], [], [], []
    one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(a_bytes, one)) != whole or b"".join(map(b_bytes, two)) != whole:
        return [], [], [], []
    one, two = spans(one, a_bytes), spans(two, b_bytes)
    cuts = sorted({e for _, e, _ in one} & {e for _, e, _ in two})
    groups, links, low = [], [], 0
    for cut in cuts:
        groups.append(([i for s, e, i in one if low < e <= cut], [i for s, e, i in two if low < e <= cut]))
        low = cut
    j = 0
    for s, e, i in one:
        while two[j][1] <= s:
            j += 1
        k = j
        while k < len(two) and two[k][0] < e:
            links.append((i, two[k][2]))
            k += 1
    return one, two, groups, links


def digest(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def brute(rows, libraries):
    done = [(i, aligned(t, libraries)) for i, t in rows]
    docs = Counter(p for _, (_, _, _, links) in done for p in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for i, (one, two, groups, links) in done:
        out.append((i, len(one), len(two), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest(groups)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """White space of all kinds at cuts, scripts without spaces, special strings, control characters, long runs."""
    r = random.Random(8)
    bits = ["word", "don't", "café", "à", " ", "  ", "\n", "\n\n", "\t", " ", "　", " ", "\u0085", "​", "\x1c", "日本語の文章", "😀", "é", "é", "<|endoftext|>", "<s>", "<0x41>", "</s>", "1234567", "!!!", "'ll", "--", "ſ", "\x00", "�", "ﬁ", "Ⅷ", "a" * 70, "▁"]
    out = [(i, "".join(r.choice(bits[: r.choice([4, 20, len(bits)])]) + (" " if r.random() < 0.6 else "") for _ in range(r.randint(1, 25)))) for i in range(600)]
    out += [(700, None), (701, ""), (702, " "), (703, "  "), (704, "x "), (705, " x"), (706, "\n"), (707, "▁"), (708, "a▁b"), (709, "a ▁ b"), (None, "no id"), (None, None), (1, "repeated"), (1, "repeated"), (710, "漢字" * 3000), (711, words(9, 6000)), (712, "-" * 5000 + " z"), (713, "<s> </s> <unk> <pad>")]
    return out


def test_query_against_whole_texts(spark, rows, libraries, tmp_path):
    make(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op13_token_alignment(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(df) == brute(rows, libraries)


def test_small_slabs_packs_and_store(rows, libraries, monkeypatch):
    """Groups across rows and slabs, and a store that is emptied all the time, give the same."""
    for name, value in (("PACK", 3), ("SLAB", 16), ("STORE", 2000), ("TEXT", 500)):
        monkeypatch.setattr(token_alignment, name, value)
    own = token_alignment.Tokenizers(JSON, MODEL)
    some = [x for x in rows if len(x[1] or "") < 400][:250] + [(900, words(3, 200)), (901, "漢字" * 60)]
    batch = pa.record_batch([pa.array([i for i, _ in some], pa.int64()), pa.array([t for _, t in some])], ["doc_id", "text"])
    table = pa.Table.from_batches(token_alignment.packed(iter([batch]), own, 5)).sort_by([("key", "ascending"), ("at", "ascending"), ("side", "ascending")])
    assert table.num_rows > 4 * len(some)
    sweep = token_alignment.Sweep(token_alignment._lengths(own), pa.int64())
    swept = pa.Table.from_batches(sweep.run(iter(table.to_batches(max_chunksize=50)))).sort_by("key").to_pylist()
    assert [r["key"] for r in swept] == list(range(5, 5 + len(some)))
    for (i, t), row in zip(some, swept, strict=True):
        one, two, groups, links = aligned(t, libraries)
        assert (row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (i, len(one), len(two), len(groups), len(links))
        assert row["groups_sha256"] == digest(groups)
        assert Counter({(p >> 48 & 0xFFFF, p >> 32 & 0xFFFF): p & 0xFFFFFFFF for p in row["pairs"]}) == Counter(links)


def test_parts(spark, rows, libraries):
    some = rows[:100]
    assert got(token_alignment.align(make(spark, some), JSON, MODEL, part=50)) == brute(some, libraries)


def test_empty(spark, empty):
    assert token_alignment.align(empty, JSON, MODEL).count() == 0
    assert [tuple(r) for r in token_alignment.align(make(spark, [(3, None)]), JSON, MODEL).collect()] == [(3, 0, 0, 0, 0, 0, 0, "")]
