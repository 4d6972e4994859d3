"""Repair against an exhaustive search over edits, by cost and then by the audit in ASCII order."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from mereling.llm import conversation_repair, oracles, queries

SCHEMA = "conv_id long, turn long, role string, text string, case long, conv string, left long, kind string"
VISIBLE = lambda t: t.strip(" \t\n\x0b\f\r")


def make(spark, rows):
    """Turns with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 7, "x", 1, "k") for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        out.append("blank" if not VISIBLE(text) else "duplicate" if (role, text) in seen else "" if VISIBLE(text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired turns): Dijkstra over (turns used, roles so far), by cost and audit."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for to in after[last]:
            if to in full:
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, (full[to], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if marks[i] not in ("blank", "duplicate"):
                extra = marks[i] == "truncated"
                for to in after[last]:
                    if role[:1] == to:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*out, (role, text))))
                    if to in full:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, to, (*out, (full[to], text))))


def brute(rows):
    """The summary of each conversation, by id."""
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = faults(own)
        cost, audit, repaired = cheapest(own, marks)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    """Conversations of all role orders and faults, ties, repeated and null turns, odd roles, a null id."""
    r = random.Random(5)
    texts = ["A b.", "C d!", "no end", "", " \t", "é ü?", "x. ", " ", "y\x1c", "line\n", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", "uh", None]
    out = []
    for conv in range(700):
        n = r.choice([1, 2, 3, 4, 5, 6, 7, 9, 14])
        for t in range(n):
            out.append((conv, r.choice([t, t, t, t + 1, None]), r.choice(roles[: r.choice([2, 5, 10])]), r.choice(texts[: r.choice([3, 11])]) if r.random() < 0.5 else f"text {r.randrange(99)}."))
    out += [(None, t, r.choice(roles), f"t{t}.") for t in range(40)] + [(-3, None, None, None)] * 3 + [(10**12, -5, "user", "Long " * 50_000 + "."), (10**12, 7, "assistant", "z")]
    return out


def test_summaries_against_search(spark, rows):
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(conversation_repair.summaries(make(spark, rows))) == brute(plain)


def test_query_against_search(spark, rows, tmp_path):
    make(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(queries.op12_conversation_repair(spark, str(tmp_path))) == {c: want.get(c, none) for c in {r[0] for r in rows}}


def test_sql(spark, rows, tmp_path):
    make(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(oracles.ORACLE_SQL["op12_conversation_repair"])
    at = [d[0] for d in want.description]
    df = queries.op12_conversation_repair(spark, str(tmp_path))
    assert sorted(at) == sorted(df.columns)
    assert got(df.select(*at)) == {r[0]: r[1:] for r in want.fetchall()}


def test_repaired_turns(spark, rows):
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = defaultdict(list)
    for r in conversation_repair.repaired(make(spark, rows)).collect():
        out[r.conv_id].append(r)
    for conv, want in brute(plain).items():
        own = sorted(out[conv], key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and "".join(r.edit for r in own) == want[-2]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == want[-1]


def test_long_conversation_in_one_shuffle(spark):
    """30,000 turns: legal pairs, then turns of an unknown role; equal to the cost worked out by hand."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(20_000)] + [(1, i, "tool", f"t{i}.") for i in range(20_000, 30_000)]
    df = conversation_repair.summaries(make(spark, rows))
    (row,) = df.collect()
    assert row.audit == "K" * 20_000 + "R" * 10_000 and row.cost == 20_000 and row.illegal == 10_000
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_empty(spark):
    assert conversation_repair.summaries(make(spark, [])).count() == 0 and conversation_repair.repaired(make(spark, [])).count() == 0
