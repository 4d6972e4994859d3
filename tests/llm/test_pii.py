import re

import pytest

from mereling.llm import pii
from tests.llm.conftest import make, words

# The base patterns of the contract, as given.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


TEXTS = [
    None, "", "a@b.c", "😀 x@y.zz%foo@bar.com @no a@b x..@a.b.c.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 0000.0.0.0000", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111",
    "+1 (202) 555-0100 +12 +1234567890123456 +49.30.123456-", "foo@bar@x.y é@ü.de ä@b.co.uk", "call 5500-0000-0000-0004 +44 20 7946 0958", "1.2.3.4a@b.c", "9" * 3000 + ".1.1.1", "a" * 20000, "." * 5000 + "@a.b",
    "x@" + ".".join(["a1"] * 9000), "1 " * 20000, words(5, 4000) + " z@q.io",
]


def test_base_spans(spark):
    df = make(spark, list(enumerate(TEXTS)))
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        for kind, spans in brute(t).items():
            assert [(s.start, s.end) for s in rows[i][kind]] == spans, (i, kind)


def test_scored_kinds(spark):
    df = make(spark, [(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB82WEST12345698765433"), (3, "my ssn is 123-45-6789"), (4, "code 123-45-6789"), (5, "ssn 000-45-6789")])
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert [(s.start, s.end, s.score) for s in rows[1].iban] == [(5, 32, 100)]
    assert [len(rows[i].iban) for i in (2, 3)] == [0, 0]
    assert [len(rows[i].ssn) for i in (3, 4, 5)] == [1, 0, 0]


def test_words_nearby_move_the_scores_of_all_kinds(spark):
    cases = [
        ("email", "Contact: a@b.cc", 100), ("email", "see a@b.cc", 70), ("ip", "host 1.2.3.4", 90), ("ip", "v 1.2.3.4", 50), ("card", "4111111111111111 (VISA)", 100), ("card", "no 4111111111111111", 80),
        ("phone", "call +49 30 123456", 90), ("phone", "+49 30 123456", 60), ("iban", "GB82WEST12345698765432", 80), ("ssn", "tax id 123-45-6789", 80),
        # within 40 code points, over other matches of the kind, and not beyond
        ("email", "mail " + "x@y.zz " * 5 + "a@b.cc", 100), ("email", "mail " + "x@y.zz " * 6 + "a@b.cc", 70), ("ip", "1.1.1.1 " + "2.2.2.2 " * 3 + "ip", 90), ("email", "mail" + "é" * 36 + " a@b.cc", 70), ("email", "mail" + "é" * 35 + " a@b.cc", 100),
    ]
    rows = {r.doc_id: r for r in pii.find_pii(make(spark, [(i, t) for i, (_, t, _) in enumerate(cases)])).collect()}
    for i, (kind, text, score) in enumerate(cases):
        found = rows[i][kind]
        assert found[0 if kind == "ip" else -1].score == score, text


def test_a_text_of_very_many_matches(spark):
    import time

    text = "".join(f"u{i}@h.de " for i in range(100_000))
    began = time.time()
    (row,) = pii.find_pii(make(spark, [(1, text)])).select("email").collect()
    assert [(s.start, s.end) for s in row.email] == brute(text)["email"] and time.time() - began < 60
    (out,) = pii.redact(make(spark, [(1, text)])).select("text").collect()
    assert out.text == "<email> " * 100_000


def test_redact_and_edges(spark, edge, empty):
    out = {r.doc_id: r.text for r in pii.redact(make(spark, [(1, "é a@b.c, b@c.d!"), (2, None), (3, "x")])).collect()}
    assert out == {1: "é <email>, <email>!", 2: None, 3: "x"}
    two = pii.redact(make(spark, [(1, "ssn 123-45-6789 GB82WEST12345698765432 1.2.3.4 9.9.9.999"), (2, "code 123-45-6789, +49 30 123456")])).collect()
    assert {r.doc_id: r.text for r in two} == {1: "ssn <ssn> <iban> <ip> 9.9.9.999", 2: "code 123-45-6789, <phone>"}
    assert pii.find_pii(edge).count() == 15 and pii.find_pii(empty).count() == 0


@pytest.mark.parametrize("text,ok", [("GB82WEST12345698765432", True), ("DE89 3704 0044 0532 0130 00", True), ("DE88370400440532013000", False)])
def test_mod97(spark, text, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.mod97(F.lit(text))).first()[0] is ok
