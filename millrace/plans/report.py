"""What runs here, and how it does."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, functions as F

from millrace.operators import extract
from millrace.sources import documents

_OPTIONAL = {"rerank": "onnxruntime", "pdf": "pymupdf", "ocr": "pytesseract", "xls": "xlrd"}


def capabilities(models: dict[str, bool] | None = None) -> dict[str, object]:
    """What can run, not what could: a runtime counts only together with its model's weights."""
    models = models or {}
    have = {k: importlib.util.find_spec(v) is not None for k, v in _OPTIONAL.items()}
    return {"extractors": extract.available(), "documents": sorted(documents.READERS), "rerank": have["rerank"] and models.get("rerank", False), "embed": have["rerank"] and models.get("embed", False), "pdf": have["pdf"], "ocr": have["ocr"], "live_fetch": False}


def status(ok: bool = True) -> dict[str, object]:
    return {"ok": ok, "engine": "millrace"}


def statistics(**tables: DataFrame) -> dict[str, list[dict]]:
    """Small summary tables (each already aggregated) as rows."""
    return {name: [x.asDict() for x in df.collect()] for name, df in tables.items()}


def evaluation(ranked: DataFrame) -> DataFrame:
    """(query_id, rank) of the right answer to mean reciprocal rank and accuracy at 1."""
    return ranked.agg(F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") == 1).cast("double")).alias("acc1"))


def margins(scored: DataFrame) -> DataFrame:
    """One row (mrr, acc1, margin) from (query_id, score, right): how well right answers are told apart.

    A query's rank counts the wrong answers that score higher than its best right one; its margin is the
    best right score less the best wrong one. Queries without a right answer add 0 to mrr and acc1.
    Only queries with both kinds have a margin.
    """
    best = scored.groupBy("query_id").agg(F.max(F.when(F.col("right"), F.col("score"))).alias("good"), F.max(F.when(~F.col("right"), F.col("score"))).alias("bad"))
    above = scored.join(best, "query_id").filter(~F.col("right") & (F.col("score") > F.col("good")))
    ranks = best.join(above.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").withColumn("rank", F.when(F.col("good").isNotNull(), F.coalesce("n", F.lit(0)) + 1))
    first = F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))
    return ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(first).alias("acc1"), F.avg(F.col("good") - F.col("bad")).alias("margin"))


def benchmark_summary(cases: DataFrame) -> DataFrame:
    """One row from cases (found, extracted, thin, elapsed_ms, failed): how a run of searches went.

    Cases that failed count as cases only.
    """
    done = ~F.col("failed")

    def total(name: str):
        return F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0))

    sums = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(done & (F.col("found") > 0)).alias("cases_with_results"), total("found").alias("results_found"),
        total("extracted").alias("pages_extracted"), total("thin").alias("thin_extractions"), F.coalesce(F.median(F.when(done, F.col("elapsed_ms"))), F.lit(0.0)).alias("__median"),
    )
    rate = F.when(F.col("results_found") > 0, F.round(F.col("pages_extracted") / F.col("results_found"), 3)).otherwise(0.0)
    return sums.withColumn("extraction_rate", rate).withColumn("median_ms", F.floor("__median").cast("long")).drop("__median")
