"""The corpus pipeline: from documents to packed token sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, minhash, packing, quality_model, toxicity
from millrace.llm._spark import forget, ready, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    ready(spark)
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    ready(spark)
    return quality_model.keep(docs, quality_model.train(docs, table(spark, sf_dir, "labels")), bound=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ready(spark)
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8."""
    ready(spark)
    return minhash.keep(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences of 2048 ids."""
    ready(spark)
    return packing.pack(docs, end_id=1)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: The classifiers and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, staged(stage(spark, docs, sf_dir), name)
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
