"""How the driver's tables stand in for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text, urls
from millrace.operators import extract

AS_OF = "2024-01-31 00:00:00"
#: Kinds of cache entries by event type.
KINDS = {"signup": "search", "view": "extract", "click": "robots", "purchase": "fetch", "error": "other"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, good, ts)."""
    return events(spark, sf_dir).select(F.col("user_id").alias("domain"), (F.col("event_type") != "error").alias("good"), "ts")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tier, ts, seq, refused)."""
    return events(spark, sf_dir).select(F.col("user_id").alias("tier"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("refused"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, key, ts, seq, value): a cache written by the events."""
    kind = F.lit("other")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return events(spark, sf_dir).select(kind.alias("kind"), F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("value"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, title, text): pages with the floor rung's prose."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", "html", text.page_title(F.col("html")).alias("title"), extract.floor_text(F.col("html")).alias("text"))


def page_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, input_pos, url, title): the pages of one host are one pool."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(urls.search_domain(F.col("url")).alias("query_id"), F.col("page_id").alias("input_pos"), "url", text.page_title(F.col("html")).alias("title"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every benchmark item whose id is divisible by 50."""
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ranking_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, once for each query, with what ranking sees of it."""
    rows = page_rows(spark, sf_dir).select(F.col("page_id").alias("input_pos"), "url", "title", F.substring("text", 1, 240).alias("text"), F.when(F.col("page_id") % 7 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd")).alias("published"))
    names = benchmark_queries(spark, sf_dir).select("query_id")  # a stated, short list against all rows
    return rows.crossJoin(F.broadcast(names))
