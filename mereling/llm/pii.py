"""PII: expressions propose spans, checksums confirm them, words nearby adjust the score.

All of it is built-in functions. A text is cut by the pattern, which gives the matches and
what lies between them; running sums of their lengths are the positions, in code points.
Sums run within blocks of a bounded number of matches, then over blocks, so the work is linear in
all texts but those of millions of matches. The words nearby a match are read from the pieces next
to it. Patterns are written so that a long run without a match costs one pass: a match cannot begin
inside a run of the characters it may begin with, except where the last match ended.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, digits and signs of an address before its @.
_LOCAL = "[A-Za-z0-9._%+-]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a match pass the Luhn checksum."""
    digits = F.reverse(F.split(_digits(match), ""))
    at = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        (d.try_cast("int") * 2) - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number (IBAN) has remainder 1 modulo 97."""
    text = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substring(text, 5, 1000), F.substring(text, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).when(
        c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.aggregate(turned, F.lit(0), step) == 1


def _few(low: int, high: int, match: Column) -> Column:
    return F.length(_digits(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """score: of a valid match, in percent. context: words (lower case) that add `lift` when they lie within NEAR code points.
    least: code points of the shortest match."""

    name: str
    pattern: str
    hint: str
    valid: object
    least: int
    score: int
    context: str
    lift: int
    base: bool = True


#: The first four kinds are kept whatever their score; the others only from THRESHOLD on.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 5, 70, "mail|contact", 30),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda m: ~m.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)"), 7, 50, "ip|address|host", 40),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", lambda m: _few(16, 19, m) & luhn(m), 2, 80, "card|visa|credit", 20),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: _few(8, 15, m), 4, 60, "phone|tel|call", 30),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, 15, 80, "iban|account|bank", 20, base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 11, 40, "ssn|social security|tax id", 40, base=False),
)
THRESHOLD, NEAR = 60, 40
#: Matches whose lengths are summed one after the other.
_BLOCK = 256
_SPAN = "array<struct<kind:string,start:int,end:int,score:int>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(text: Column, kind: Kind) -> Column:
    """(b, m) per match: what lies before it, and the match; the last one has what follows and no match."""
    return F.arrays_zip(F.split(text, kind.pattern, -1).alias("b"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))


def _score(pieces: Column, i: Column, kind: Kind) -> Column:
    """The score of match i, by the words in the NEAR code points before and after it."""
    k = -(-NEAR // kind.least)  # so many matches fill them
    flat = lambda part: F.array_join(F.transform(part, lambda p: F.concat(p["b"], F.coalesce(p["m"], F.lit("")))), "")
    ends = lambda part: F.transform(part, lambda p: F.struct(F.right(p["b"], F.lit(NEAR)).alias("b"), p["m"].alias("m")))
    heads = lambda part: F.transform(part, lambda p: F.struct(F.left(p["b"], F.lit(NEAR)).alias("b"), p["m"].alias("m")))
    before = F.right(F.concat(flat(ends(F.slice(pieces, F.greatest(i - k, F.lit(0)) + 1, F.least(i, F.lit(k))))), F.get(pieces, i)["b"]), F.lit(NEAR))
    after = F.left(flat(heads(F.slice(pieces, i + 2, F.lit(k + 1)))), F.lit(NEAR))
    return kind.score + F.when(F.lower(F.concat(before, F.lit(" "), after)).rlike(kind.context), kind.lift).otherwise(0)


def _placed(pieces: Column) -> Column:
    """(start, end, i) of all matches, by running sums."""
    n = F.size(pieces) - 1

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["b"])
        return F.struct((start + F.length(p["m"])).alias("at"), F.concat(a["all"], F.array(F.struct(start.alias("start"), (start + F.length(p["m"])).alias("end")))).alias("all"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda k: F.aggregate(F.slice(pieces, k * _BLOCK + 1, F.least(n - k * _BLOCK, F.lit(_BLOCK))), none, step))

    def shifted(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        begins = F.aggregate(blocks, first, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(blocks, begins, lambda x, at: F.transform(x["all"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))

    spans = F.transform(_let(blocks, shifted), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,i:int>>"))


def _found(text: Column, kind: Kind) -> Column:
    """The kind's confirmed spans, as an array; none costs one test for the hint."""

    def spans(pieces: Column) -> Column:
        valid = F.filter(_placed(pieces), lambda s: kind.valid(F.get(pieces, s["i"])["m"]))
        return F.transform(valid, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(pieces, s["i"], kind).alias("score")))

    found = _let(_pieces(text, kind), spans)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.hint), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per input row: doc_id and, for each kind, an array of (kind, start, end, score in percent).

    Starts are code points from 0, ends exclusive, in order of start; matches of one kind do
    not overlap, those of two kinds may. A null text is an empty one and has no spans; null
    ids and repeated rows are passed on as they are; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select("doc_id", *(_found(F.col("_text"), k).alias(k.name) for k in kinds))


def spans_text(*arrays: Column) -> Column:
    """Spans as kind:start:end, joined by commas, in the arrays' order."""
    return F.concat_ws(",", *(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for a in arrays))


def scores_text(*arrays: Column) -> Column:
    """The scores of the spans, in percent, joined likewise."""
    return F.concat_ws(",", *(F.transform(a, lambda s: s["score"].cast("string")) for a in arrays))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`docs` with confirmed spans of each kind replaced by <kind>, kind by kind; all columns stay."""
    def cut(kind: Kind) -> Column:
        text = F.coalesce(F.col(text_col), F.lit(""))

        def joined(pieces: Column) -> Column:
            def part(p: Column, i: Column) -> Column:
                ok = p["m"].isNotNull() & kind.valid(F.coalesce(p["m"], F.lit("")))
                ok = ok if kind.base else ok & (_score(pieces, i, kind) >= THRESHOLD)
                return F.concat(p["b"], F.when(ok, f"<{kind.name}>").otherwise(F.coalesce(p["m"], F.lit(""))))

            return F.array_join(F.transform(pieces, part), "")

        return F.when(text.rlike(kind.hint), _let(_pieces(text, kind), joined)).otherwise(F.col(text_col))

    out = docs
    for kind in kinds:
        out = out.withColumn(text_col, cut(kind))
    return out
