"""The record of domains: decayed outcomes, scores, order, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import scores

HALF_LIFE, LEAST, FLOOR, HIDDEN = 14.0, 5.0, 0.3, 0.5


def decayed(log: DataFrame, as_of: Column, half_life: float = HALF_LIFE) -> DataFrame:
    """(domain, ok, fail): outcomes (domain, good, ts) with half the weight every half-life.

    The decay composes, so one partial aggregation gives what updating a record in order would.
    """
    weight = scores.decay(F.col("ts"), as_of, half_life)
    return log.groupBy("domain").agg(F.sum(F.when(F.col("good"), weight).otherwise(0.0)).alias("ok"), F.sum(F.when(F.col("good"), 0.0).otherwise(weight)).alias("fail"))


def scored(record: DataFrame, least: float = LEAST, floor: float = FLOOR) -> DataFrame:
    """record with score and is_poor: enough evidence, and most of it bad."""
    score = scores.laplace(F.col("ok"), F.col("fail"))
    return record.withColumn("score", score).withColumn("is_poor", (F.col("ok") + F.col("fail") >= least) & (score < floor))


def report(record: DataFrame, most: int = 20) -> DataFrame:
    """The worst domains with evidence left, rounded."""
    rows = scored(record).filter(F.col("ok") + F.col("fail") >= HIDDEN)
    return rows.select("domain", F.round("ok", 2).alias("ok"), F.round("fail", 2).alias("fail"), F.round("score", 3).alias("score"), "is_poor").orderBy("score", "domain").limit(most)
