"""The operators bound to the driver's tables, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mereling.llm import conversation_repair, decontaminate, exact_dedup, near_dedup, nearest, pii, scratch, sentencepiece_codec, substring_dedup, token_alignment, token_counts, toxicity, url_filter, warc

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_file() -> str:
    """The SentencePiece model of the public tokenizers that the machines have."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), passage=decontaminate.PASSAGE)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model_file())


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grades from the labels: 2 toxic, 1 not toxic but of low quality, 0 neither."""
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, graded(spark, sf_dir), 3))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_file())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch.new_path(spark, "warc"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = [F.col(k.name) for k in pii.KINDS if k.base]
    every = [F.col(k.name) for k in pii.KINDS]
    return found.select(
        "doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.KINDS if k.base),
        F.sha2(pii.spans_text(*base), 256).alias("base_sha256"), pii.spans_text(*every).alias("spans"), pii.scores_text(*every).alias("scores"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged conversations repaired; one of which no turn is left has zeros."""
    turns = table(spark, sf_dir, "conversations")
    done = conversation_repair.summaries(conversation_repair.damage(turns)).withColumnRenamed("conv_id", "_id")
    out = turns.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return out.select("conv_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in conversation_repair.COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), model_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_pii": op10_pii,
    "op11_nearest": op11_nearest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_alignment": op13_token_alignment,
}
