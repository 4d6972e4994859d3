import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from mereling.llm import pretokens, sentencepiece_codec as C, token_counts
from tests.llm.conftest import make

MODEL = P.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    r = random.Random(9)
    alphabet = list("abcthe  \n\t▁ée😀<s>/門") + [" the", "</s>", "  ", "　"]
    return [None, "", " ", "   ", "a", " a ", "▁", "<s>", "x\x00y"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(300)]


def test_counts_are_the_librarys(spark, edge, edge_rows):
    texts = odd_texts()
    rows = {r.doc_id: r for r in token_counts.count_tokens(make(spark, list(enumerate(texts))), MODEL, table_size=16).collect()}
    for i, t in enumerate(texts):
        n = len(SP.encode(t or ""))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 4096), repr(t)
    got = sorted((repr(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(edge, MODEL).collect())
    assert got == sorted((repr(i), len(SP.encode(t or ""))) for i, t in edge_rows)


def test_words_that_sums_of_powers_confuse(spark):
    for n in (1024, 2048, 4096):
        one = "a"
        while len(one) < n:
            one += one.translate(str.maketrans("ab", "ba"))
        texts = [one, one.translate(str.maketrans("ab", "ba")), "x " + one]
        df = make(spark, list(enumerate(texts)))
        for table_size in (0, 1, 16):
            assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, MODEL, table_size=table_size).collect()} == {i: len(SP.encode(t)) for i, t in enumerate(texts)}
        assert all(r.round_trip for r in C.encode(df, MODEL).collect())


def test_table_compares_bytes(monkeypatch):
    tokens = [b" aa", b" ab", b" b", b" cc"]
    monkeypatch.setattr(token_counts.words, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    table = token_counts.Table(tokens, [1, 2, 3, 4])
    assert table.get(pa.array([b" ab", b" zz", b" b", b" aa", b" cc", b" c"], pa.large_binary())).tolist() == [2, -1, 3, 1, 4, -1]


def test_counts_read_the_texts_once_and_shuffle_nothing(edge):
    plan = token_counts.count_tokens(edge, MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_model_without_byte_pieces_uses_the_unknown_piece():
    codec = C.Codec(MODEL)
    codec.bytes = {}
    ids = codec.segment(pretokens.SPACE + "😺\u0870")
    assert codec.unknown in ids


def test_counts_empty(empty):
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def best_score(codec, text):
    """Viterbi over all substrings."""
    s = (" " + text).replace(" ", pretokens.SPACE)
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        best[e] = best[e - 1] + codec.fallback
        for b in range(max(0, e - 16), e):
            if s[b:e] in codec.score:
                best[e] = max(best[e], best[b] + codec.score[s[b:e]][1])
    return best[-1]


def test_viterbi_is_best_and_round_trips(spark, edge, edge_rows):
    texts = odd_texts()
    codec = C.codec(MODEL)
    score = {i: s for i, s in codec.score.values()}
    coded = C.encode(make(spark, list(enumerate(texts))), MODEL)
    rows = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        plain = (t or "").replace(pretokens.SPACE, " ")
        ids = rows[i].ids
        assert rows[i].round_trip == (pretokens.SPACE not in (t or "")) and rows[i].n_tokens == len(ids)
        assert SP.decode(list(ids)) == plain
        if not plain:
            assert not ids
            continue
        # a run of bytes is one character each
        total, k = 0.0, 0
        raw = {v: b for b, v in codec.bytes.items()}
        while k < len(ids):
            if ids[k] in raw:
                b = raw[ids[k]]
                k += 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                total += codec.fallback
            else:
                total += score[ids[k]]
                k += 1
        assert total == pytest.approx(best_score(codec, plain))
    back = {r.doc_id: r.text for r in C.decode(coded, MODEL).collect()}
    assert back == {i: (t or "").replace(pretokens.SPACE, " ") for i, t in enumerate(texts)}
    signs = {i for i, t in edge_rows if pretokens.SPACE in (t or "")}
    assert all(r.round_trip == (r.doc_id not in signs) for r in C.encode(edge, MODEL).collect())


def test_codec_empty(spark, empty):
    assert C.encode(empty, MODEL).count() == 0
    assert [r.text for r in C.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), MODEL).collect()] == ["", ""]


def test_texts_without_spaces_fill_no_cache():
    """Long pre-tokens are segmented right and not kept; the cache is bounded in bytes."""
    import pyarrow as pa

    from mereling.llm import sentencepiece_codec as C
    from mereling.llm.queries import model_file

    texts = pa.array(["".join(chr(0x4E00 + (7 * i + k) % 9000) for k in range(3000)) for i in range(20)] + ["a few words"])
    own = C.Codec(model_file())
    ids, offsets = own.encode_batch(texts)
    assert all(len(k) <= C.LONG for k in own.cache) and 0 < own.held < 5000
    data, at = own.decode_batch(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == texts.to_pylist()


def test_counts_of_texts_without_spaces(spark):
    from mereling.llm import token_counts as T
    from mereling.llm.queries import model_file

    texts = ["".join(chr(0x4E00 + (7 * i + k) % 9000) for k in range(500)) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sp = T.processor(model_file())
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(df, model_file()).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
