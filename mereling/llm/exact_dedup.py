"""Exact dedup: group by a 128-bit content hash and compare bytes inside the groups.

All of it is DataFrame operations. Hashes are counted first, without the texts. A hash that occurs
more than once sets a bit of a bitmap of fixed size, which is broadcast; texts whose bit isn't set
are alone and never shuffled. The others meet by (hash, text), combined before and after the
shuffle, so a text of a third of all rows becomes one row per task. Equal hash with other bytes
makes two rows there, which is how collisions show; only such hashes go the slower way that joins
on the bytes. The way back to the rows is a join on the hash whose row side is a plain shuffle that
adaptive execution splits where it is skewed.

Where far more hashes repeat than the bitmap has bits, it holds nothing back, and all texts are
shuffled once: slower, with the same result.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mereling.llm import scratch


def content_hash(text: Column) -> Column:
    """The 128-bit hash of a text's bytes, as binary."""
    return F.unhex(F.md5(text.cast("binary")))


#: Bits of the bitmap (8 MB).
BITS = 1 << 26


def _may_repeat(rows: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (_hash, ...) whose hash may be one of `repeated`, and those whose hash isn't."""
    place = F.pmod(F.xxhash64("_hash"), F.lit(BITS))
    bitmaps = repeated.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bits"))
    bitmaps = scratch.keep(bitmaps, "repeated-bits")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # at most BITS / 8 bytes
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "_bucket", "left").withColumn(
        "_set", F.col("_bits").isNotNull() & (F.getbit(F.coalesce(byte, F.lit(0)), (bit % 8).cast("int")) == 1)).drop("_bucket", "_bits")
    return met.where("_set").drop("_set"), met.where("not _set").drop("_set")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 normalise: Callable[[Column], Column] | None = None,
                 hash_text: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: whether the smallest or the largest id of equal texts stays. normalise: applied to
    the text before it is compared. Null and empty texts are one group. A null id stays only
    where its group has no other; all its null-id rows are then kept=true for the group's
    keep_id null. Repeated rows of the kept id are all kept (`drop_copies` leaves one).
    An empty table gives an empty table. Columns besides id and text are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", hash_text(F.col("_text")))
    stays = F.max if keep == "largest" else F.min
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    groups = scratch.keep(rows.select("_id", "_hash", sha.alias("_sha")).groupBy("_hash").agg(stays("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"), F.max("_sha").alias("_sha")), "exact-groups")
    some, _ = _may_repeat(rows.select("_hash", "_text"), groups.where("_n > 1"))
    texts = some.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"))
    collided = scratch.keep(texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_hash"), "exact-collisions")
    ids = rows.select("_id", "_hash")
    if collided.isEmpty():
        out = ids.join(groups, "_hash")
    else:
        out = ids.join(groups.join(collided, "_hash", "left_anti"), "_hash")
        odd = rows.join(collided, "_hash", "left_semi")
        each = odd.groupBy("_hash", "_text").agg(stays("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).withColumn("_sha", sha)
        out = out.unionByName(odd.join(each, ["_hash", "_text"]).drop("_text"))
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat id and text, any one.

    Null ids give way to others. Rows whose text is alone stay where they are; the others' texts meet
    once, in one row per task for each distinct text, grouped by hash and compared byte by byte.
    Clashing names are safe: the row travels as one struct.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_id = F.col(id_col).isNotNull()
    order = F.struct(has_id, F.col(id_col)) if keep == "largest" else F.struct(~has_id, F.col(id_col))
    best = F.max_by if keep == "largest" else F.min_by
    rows = docs.select(content_hash(text).alias("_hash"), text.alias("_text"), order.alias("_order"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    repeated = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    some, alone = _may_repeat(rows, repeated)
    return some.groupBy("_hash", "_text").agg(best("_row", "_order").alias("_row")).select("_row.*").unionByName(alone.select("_row.*"))
