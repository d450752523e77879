"""A pipeline over documents: reject poor ones, keep one of each group of near copies, drop benchmark leaks, mask
personal data, and mix the sources to target weights. Each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import co_training, decontamination, jaccard_join, mixing, pii
from tidemark.llm.shared import store
from tidemark.ship import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps."""
    return co_training.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars counts the new text."""
    from pyspark.sql import functions as F

    out = pii.sanitize(docs)
    n = F.length("text").cast("long")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), n).otherwise(F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with all its columns and the words that the mix takes of it."""
    return mixing.mixed(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("PII", private), ("mixing", mixture)]

#: SQL can express neither the classifier nor the joins; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{i}")
    return docs
