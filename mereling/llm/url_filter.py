"""URL filters: hand-made rules first, else a tree of path templates learnt per host.

The tree is built level by level with DataFrame operations. At each level a path segment stays
literal if it is frequent and its labelled purity differs from that of its siblings; all others,
variable ones, merge into the wildcard `*`. Of the literal ones, those that are worse than their
siblings merge into one branch, `#bad`, if their shares don't differ from that of all of them, and
those that are better into `#good`. (A path holds no `#`.) The levels end where no branch has both
good and bad pages in sufficient number, for then none below can differ. A template is rejected by
the smoothed share of bad pages among its labelled ones. Only the literal segments of a level, each
with a minimum of pages, are kept between levels; page rows are never collected or grouped whole.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mereling.llm import scratch


@dataclass(frozen=True)
class Settings:
    min_pages: int = 20  # a literal segment has at least so many pages under its parent
    z: float = 2.58  # and so many standard errors between its bad share and its siblings'
    prior: float = 10.0  # pages' worth of the host's (and for hosts, of all pages') bad share
    reject: float = 0.5  # a template with a smoothed bad share of at least this is blocked


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both '' where there is no `://` or the url is null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text (null: none) and its verdict. rules: (allow or block, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _walk(rows: DataFrame, literals: list[DataFrame | None]) -> DataFrame:
    """`rows` with their template so far: per level, a join with its literal segments if it has any."""
    for i, known in enumerate(literals):
        rows = rows.withColumn("_seg", F.try_element_at("_segs", F.lit(i + 1)))
        rows = rows.join(known, ["_host", "_tpl", "_seg"], "left") if known is not None else rows.withColumn("_lit", F.lit("*"))
        rows = rows.withColumn("_tpl", F.when(F.col("_seg").isNull(), F.col("_tpl")).otherwise(F.concat("_tpl", F.lit("/"), F.coalesce("_lit", F.lit("*"))))).drop("_seg", "_lit")
    return rows


def _literals(at: DataFrame, whole: DataFrame, settings: Settings) -> DataFrame:
    """The segments of a level that don't become `*`, and what they become: themselves, `#bad` or `#good`."""
    each = at.groupBy("_host", "_tpl", "_seg").agg(F.count(F.lit(1)).alias("n"), F.sum("_l").alias("l"), F.sum("_b").alias("b"))
    both = each.where(F.col("n") >= settings.min_pages).join(whole, ["_host", "_tpl"])
    some = lambda c: F.when(c > 0, c)
    l, rest_l, rest_b = some(F.col("l")), some(F.col("pl") - F.col("l")), F.col("pb") - F.col("b")
    share, z2 = F.col("pb") / some(F.col("pl")), settings.z * settings.z
    gap = F.col("b") / l - rest_b / rest_l
    apart = both.withColumn("gap", gap).where(gap * gap > z2 * (share * (1 - share) * (1 / l + 1 / rest_l)))
    apart = apart.select("_host", "_tpl", "_seg", "l", "b", F.when(F.col("gap") > 0, "#bad").otherwise("#good").alias("side"))
    sides = apart.groupBy("_host", "_tpl", "side").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("k"))
    pool = F.col("sb") / F.col("sl")
    off = F.col("b") / F.col("l") - pool
    alike = (F.col("k") > 1) & (off * off <= z2 * (pool * (1 - pool) * (1 / F.col("l") + 1 / F.col("sl"))))
    return apart.join(sides, ["_host", "_tpl", "side"]).select("_host", "_tpl", "_seg", F.when(alike, F.col("side")).otherwise(F.col("_seg")).alias("_lit"))


def templates(pages: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, template, bad_share (smoothed, of its template).

    labels: (page_id, bad boolean), at most one vote a page after `max`; null votes and ids
    count for nothing. Null and schemeless urls share the host '' and the empty path.
    """
    host, path = parse(F.col(url_col))
    votes = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("_bad"))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")).join(votes, F.col("_id") == F.col("page_id"), "left").select(
        "_id", "_host", "_path", F.col("_bad").isNotNull().cast("long").alias("_l"), F.coalesce(F.col("_bad").cast("long"), F.lit(0).cast("long")).alias("_b"))
    rows = scratch.keep(rows, "url-rows")
    walked = rows.withColumn("_segs", F.when(F.col("_path") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace("_path", "^/", ""), "/", -1))).withColumn("_tpl", F.lit(""))
    literals: list[DataFrame | None] = []
    while True:  # as many levels as there are mixed branches
        at = _walk(walked, literals).withColumn("_seg", F.try_element_at("_segs", F.lit(len(literals) + 1))).where("_seg is not null")
        whole = at.groupBy("_host", "_tpl").agg(F.count(F.lit(1)).alias("n"), F.sum("_l").alias("pl"), F.sum("_b").alias("pb"))
        whole = scratch.keep(whole.where((F.col("n") >= settings.min_pages) & (F.col("pb") > 0) & (F.col("pb") < F.col("pl"))).drop("n"), "url-branches")
        if whole.isEmpty():
            break
        found = scratch.keep(_literals(at, whole, settings), "url-literals")
        literals.append(None if found.isEmpty() else found)
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("_segs") - len(literals), F.lit(0)))
    done = _walk(walked, literals).withColumn("_tpl", F.concat("_tpl", rest))
    shares = scratch.keep(done.groupBy("_host", "_tpl").agg(F.sum("_l").alias("l"), F.sum("_b").alias("b")), "url-templates")
    hosts = shares.groupBy("_host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    total = shares.agg(F.coalesce(F.sum("b") / F.when(F.sum("l") > 0, F.sum("l")), F.lit(0.0)).alias("g"))
    a = F.lit(settings.prior)
    judged = shares.join(hosts, "_host").crossJoin(F.broadcast(total))  # one row
    judged = judged.withColumn("_hs", (F.col("hb") + a * F.col("g")) / (F.col("hl") + a)).select(
        "_host", "_tpl", ((F.col("b") + a * F.col("_hs")) / (F.col("l") + a)).alias("_share"))
    return done.join(judged, ["_host", "_tpl"]).select(
        F.col("_id").alias("page_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_tpl").alias("template"), F.col("_share").alias("bad_share"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), template, bad_share.

    A rule decides where one fits; else the template does. Repeated rows are judged alike; an
    empty table gives an empty table; other columns are not read.
    """
    rows = templates(pages, labels, settings, id_col, url_col)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= settings.reject, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "bad_share")
