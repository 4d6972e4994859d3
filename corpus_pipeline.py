"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four
return the columns of `documents` for the rows that stay; the last returns token ids.
"""

from pyspark.sql import DataFrame, SparkSession

from mereling.llm import decontaminate, exact_dedup, near_dedup, scratch, sentencepiece_codec, toxicity
from mereling.llm.queries import graded, model_file, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted severity isn't the top grade."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, graded(spark, sf_dir), 3))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), passage=decontaminate.PASSAGE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row."""
    return sentencepiece_codec.encode(docs, model_file())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("sentencepiece", tokenize)]

#: The classifier, the verified near-duplicate classes and the alignments are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
