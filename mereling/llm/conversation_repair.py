"""Repair of a conversation's structure: faulty turns out, roles in turn, at the least cost.

A repaired conversation has the role initials `(s?(ua)+)?`. Its turns are a subsequence of the given
ones, kept (K) or given another role (R, cost 2), with empty turns inserted (I, cost 2) where two
neighbours' roles need them; what is between two retained turns is deleted (D, cost 3). Blank and
duplicate turns are always deleted; a truncated one that stays adds 1.

The dynamic programme runs over retained turns, from the last to the first. With `deleted` the
running sum of deletion costs, a turn retained as role s offers `its cost + cost after it - deleted`;
`Minima` keeps the least offer of each role, and a gap's price is the difference of two sums, so a turn
is weighed against three offers, not against all later turns. The pair of roles gives the number of
inserts. Of equal costs the audit that is least in ASCII wins (D < I < K < R): the offer of the later
turn, then more inserts, then a kept turn; that is decided at the gap, for what follows it differs no more.

Turns go to their conversation's task in one shuffle; two sorts within it, last to first and then first to
last, feed two streams that hold no more than one turn and four offers (and, for summaries, a letter
per turn), so a conversation of any length is repaired. A conversation isn't split: its audit and its hash
are chains over all its turns. Faults are found by Spark functions, duplicates by a window of the same
partitioning.

Turns are ordered by turn (nulls first), then role and text by their bytes. Null roles and texts are one
space; a null id is a conversation of its own. Other columns are not read. An empty table gives no rows.
"""

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
REROLE, INSERT, DELETE, CUT_OFF = 2, 2, 3, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts between neighbours of these roles, and after the last turn.
INSERTS = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
AT_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = ("su", "ua", "au")
_GO = "go_start long, go_system long, go_user long, go_assistant long"


class Minima:
    """The least offer of each role among the turns seen so far, from the last turn on."""

    def __init__(self):
        self.deleted = self.seen = 0
        self.offers: dict[int, tuple[int, int, str]] = {}  # role: cost less the deletions from there on, turn, letter
        self.after = self.choices()

    def choices(self) -> list[tuple[int, int]]:
        """(cost, target) of what is left, by the role before it; a target is turn * 4 + role, or -1 for none."""
        out = []
        for role in (START, SYSTEM, USER, ASSISTANT):
            best = (self.deleted + INSERT * AT_END[role], -1, 0, "")
            target = -1
            for to, (cost, turn, letter) in self.offers.items():
                inserts = INSERTS.get((role, to))
                if inserts is not None and (key := (cost + self.deleted + INSERT * inserts, turn, -inserts, letter)) < best:
                    best, target = key, turn * 4 + to
            out.append((best[0], target))
        return out

    def add(self, kind: int, fault: int) -> list[tuple[int, int]]:
        """Take the turn before those seen, and choose again."""
        own = {}
        if fault not in (BLANK, DUPLICATE):
            extra = CUT_OFF if fault == TRUNCATED else 0
            if kind == SYSTEM:
                own[SYSTEM] = (extra, "K")
            for to in ROLES:
                own[to] = (extra, "K") if kind == to else (extra + REROLE, "R")
        self.deleted += DELETE
        for to, (cost, letter) in own.items():
            offer = cost + self.after[to][0] - self.deleted
            if to not in self.offers or offer < self.offers[to][0]:  # of equal ones the later turn stays
                self.offers[to] = (offer, self.seen, letter)
        self.seen += 1
        self.after = self.choices()
        return self.after


def text_or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def faulty(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, kind and fault of each turn, dealt by conversation."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_or_space(F.col(role_col)).alias("role"), text_or_space(F.col(text_col)).alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    visible = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    fault = F.when(visible == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.substring(visible, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.repartition("conv").withColumn("seen", seen).select("conv", "turn", "role", "text", kind.alias("kind"), fault.alias("fault"), "seen")


def _new(conv: list, last) -> Iterator[bool]:
    """Whether each conversation id differs from the one before."""
    return (a is not b and a != b for a, b in zip(conv, chain(last, conv)))


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns from the last to the first: each with its number from the end and, by the role before it, the target."""
    minima, last = Minima(), [object()]
    for batch in batches:
        numbers, targets = [], ([], [], [], [])
        conv = batch.column(0).to_pylist()
        for new, kind, fault in zip(_new(conv, last), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if new:
                minima = Minima()
            numbers.append(minima.seen)
            for to, (_, target) in zip(targets, minima.add(kind, fault), strict=True):
                to.append(target)
        last = conv[-1:] or last
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), *(pa.array(t, pa.int64()) for t in targets)], [*batch.schema.names, "left", "go_start", "go_system", "go_user", "go_assistant"])


def planned(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns of each conversation in order, with the targets that `_plan` chose."""
    rows = faulty(turns, conv_col, turn_col, role_col, text_col)
    down = rows.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("seen"))
    kinds = ", ".join(f"{n} {down.schema[n].dataType.simpleString()}" for n in down.columns)
    return down.mapInArrow(_plan, f"{kinds}, left long, {_GO}").sortWithinPartitions("conv", F.desc("left"))


Turn = tuple[str, str | None, str | None]  # edit, role and text after it


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[list[Turn], tuple]], bool]]:
    """(conversation, [(edits, turn given or None)], ended) in order; the edits of a turn end with the turn's own."""
    last, held, role, target = [object()], None, START, None
    empty = lambda before, n: [("I", ROLES[r], "") for r in (([USER, ASSISTANT] if before in (START, SYSTEM, ASSISTANT) else [ASSISTANT]) if n else [])[:n]]
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        out: list = []
        for new, row in zip(_new(columns[0], last), zip(*columns, strict=True)):
            conv, turn, given, text, kind, fault, _, left, *go = row
            if new:
                if held is not None:
                    yield held, [*out, (empty(role, AT_END[role]), None)], True
                out, held, role, target = [], (conv,), START, None
            target = go[role] if target is None else target
            if target >> 2 == left and target >= 0:
                to = target & 3
                out.append(([*empty(role, INSERTS[role, to]), ("K", given, text) if kind == to else ("R", ROLES[to], text)], (turn, given, fault)))
                role, target = to, None
            else:
                out.append(([("D", None, None)], (turn, given, fault)))
        last = columns[0][-1:] or last
        if out:
            yield held, out, False
    if held is not None:
        yield held, [(empty(role, AT_END[role]), None)], True


def _streamed(turns: DataFrame, make: Callable, schema: str, names: tuple[str, str, str, str]) -> DataFrame:
    kind = turns.schema[names[0]].dataType.simpleString()
    return planned(turns, *names).mapInArrow(make, f"conv_id {kind}, {schema}")


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of each conversation in order: conv_id, place long (from 0), edit, turn, role, text.

    A deleted turn has no role and text, an inserted one no turn. The rows that aren't deleted are the
    repaired conversation.
    """
    names, turn_kind = (conv_col, turn_col, role_col, text_col), turns.schema[turn_col].dataType.simpleString()

    def run(batches):
        place, rows = 0, []
        for batch in batches:
            names = ["conv_id", "place", "edit", "turn", "role", "text"]
            schema = pa.schema(zip(names, [batch.schema.field(0).type, pa.int64(), pa.string(), batch.schema.field(1).type, pa.string(), pa.string()], strict=True))
            for (conv,), steps, ended in _edits(chain([batch], batches)):
                for edits, step in steps:
                    for edit, role, text in edits:
                        rows.append((conv, place, edit, None if step is None or edit == "I" else step[0], role, text))
                        place += 1
                place = 0 if ended else place
                if len(rows) >= 4096:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)

    return _streamed(turns, run, f"place long, edit string, turn {turn_kind}, role string, text string", names)


class Summary:
    """What is counted of one conversation, turn by turn."""

    def __init__(self):
        self.low = self.high = self.initial = None
        self.turns = self.illegal = self.cost = self.lines = 0
        self.faults, self.audit, self.hash = [0, 0, 0, 0], bytearray(), hashlib.sha256()

    def add(self, edits: list[Turn], step: tuple | None) -> None:
        if step is not None:
            turn, role, fault = step
            self.faults[fault] += 1
            if turn is not None and turn != self.high:  # turns come in order
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
            self.cost += CUT_OFF * (fault == TRUNCATED and edits[-1][0] != "D")
        for edit, role, text in edits:
            self.audit += edit.encode()
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
            if edit != "D":
                self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
                self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summaries(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers that are missing between the least and the greatest. blank, duplicate, truncated:
    turns by their first fault. illegal: neighbours that aren't su, ua or au, as given. audit: the edits.
    repaired_sha256: of the repaired turns as `role:text`, joined by line feeds.
    """

    def run(batches):
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            rows, own = [], Summary()
            for (conv,), steps, ended in _edits(chain([batch], batches)):
                for edits, step in steps:
                    own.add(edits, step)
                if ended:
                    rows.append((conv, *own.row()))
                    own = Summary()
                if len(rows) >= 4096:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)

    return _streamed(turns, run, ", ".join(f"{n} long" for n in COUNTS) + ", audit string, repaired_sha256 string", (conv_col, turn_col, role_col, text_col))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def damage(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with faults by a hash of each turn's key: some dropped, emptied, cut, repeated or given to the user.

    A null in the key, a role or a text is one space. Repeated rows share a key and so a fault.
    """
    case = F.crc32(F.concat(text_or_space(F.col("conv_id")), F.lit(":"), text_or_space(F.col("turn"))).cast("binary")) % 20
    text, role = text_or_space(F.col("text")), text_or_space(F.col("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("case")).where("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("case") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")
