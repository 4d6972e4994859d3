"""Connected components of a table of links, by alternating large and small stars.

Each round is two joins of the links with each node's least neighbour. The least neighbours are
written tables, so the join's sides are plain shuffles and a node with very many links is split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mereling.llm import scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u > v)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = scratch.keep(least.select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each u has one link and no v is a u."""
    ends = links.select("u", F.lit(1).alias("n")).unionByName(links.select(F.col("v").alias("u"), F.lit(None).cast("int").alias("n")))
    odd = ends.groupBy("u").agg(F.count("n").alias("up"), F.count(F.lit(1)).alias("all")).where("up > 1 or (up = 1 and all > 1)")
    return odd.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node that has a link to another: node, component (its least node).

    Links are undirected; nulls, loops and repeated links change nothing; an empty table gives
    an empty one. Nodes may be of any ordered type.
    """
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = scratch.keep(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while not _stars(now):
        with scratch.temporary():
            now = scratch.keep(_star(scratch.keep(_star(now, True), "links"), False), "links", stays=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
