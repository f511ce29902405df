"""The search pipeline: pools in, ranked pools out, and which stages ran."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import urls
from millrace.operators import corpus as store, dedup, ranking
from millrace.plans import fetch as fetching
from millrace.sources import feeds


@dataclass(frozen=True)
class Options:
    """Options of a search; unknown names and empty limits are errors."""

    limit: int = 10
    bm25: bool = True
    rerank: bool = False
    recency: float = 0.0
    prefer: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.limit < 1:
            raise ValueError("limit must be 1 or more")
        if not 0 <= self.recency <= 1:
            raise ValueError("recency must lie in 0..1")

    @classmethod
    def of(cls, **given) -> Options:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**given)


#: How many rows are kept for ranking, for each row asked for.
OVERFETCH = 3


#: A source: (query_id, query, domain) rows into (query_id, domain, input_pos, url, title, ...) rows.
Source = Callable[[DataFrame], DataFrame]


def appended(pool: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """pool with the rows whose key is no canonical address of the query's pool, each key once, behind its own."""
    known = pool.select("query_id", urls.canonical_url(F.col("url")).alias("__key"))
    fresh = rows.withColumn("__key", key).filter(F.col("__key") != "").join(known, ["query_id", "__key"], "left_anti")
    once = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__key").orderBy("input_pos", "url"))).filter("__n = 1")
    last = pool.groupBy("query_id").agg(F.max("input_pos").alias("__last"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("input_pos", "url")) + F.coalesce("__last", F.lit(0))
    return pool.unionByName(once.join(last, "query_id", "left").withColumn("input_pos", place).drop("__key", "__n", "__last"), allowMissingColumns=True)


def swept(pool: DataFrame, queries: DataFrame, prefer: list[str], source: Source) -> DataFrame:
    """pool with rows from preferred domains, for the queries whose pool is short of them.

    Their key is weaker than the pool's own: the address without its query and last slash.
    """
    short = queries.join(ranking.trusted_share(pool, prefer).filter("sweep").select("query_id"), "query_id", "left_semi")
    found = feeds.on_domain(source(feeds.sweep_queries(short, prefer)))
    order = Window.partitionBy("query_id").orderBy("domain", "input_pos")
    rows = found.withColumn("input_pos", F.row_number().over(order)).drop("domain")
    return appended(pool, rows, F.regexp_replace(F.substring_index(F.col("url"), "?", 1), "/+$", ""))


def with_headlines(pool: DataFrame, rows: DataFrame) -> DataFrame:
    """pool with the first headlines (query_id, input_pos, title, ...) of each query whose title it lacks."""
    fresh = dedup.unknown_titles(rows, pool)
    last = pool.groupBy("query_id").agg(F.max("input_pos").alias("__last"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("input_pos")) + F.coalesce("__last", F.lit(0))
    return pool.unionByName(fresh.join(last, "query_id", "left").withColumn("input_pos", place).drop("__last"), allowMissingColumns=True)


def search(queries: DataFrame, sources: list[DataFrame], options: Options = Options(), hits: DataFrame | None = None, domains: DataFrame | None = None, as_of: Column | None = None, score=None, sweep: Source | None = None, headlines: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(rows, stages) for any number of queries at once.

    queries: (query_id, query); sources: pools in order of preference, each (query_id, input_pos, url,
    title, text, ...); hits: corpus rows to merge; domains: the record for reordering; score: a
    reranking model's column maker; sweep: a source asked for the preferred domains where a pool is
    short of them; headlines: rows without an address that stand behind the pool's own.
    """
    stages = ["merge", "dedup", "junk"]
    pool = ranking.without_junk(dedup.greedy(dedup.merged(sources)))
    if headlines is not None:
        pool, stages = with_headlines(pool, headlines), [*stages, "headlines"]
    if sweep is not None and options.prefer:
        pool, stages = swept(pool, queries, list(options.prefer), sweep), [*stages, "sweep"]
    stages = [*stages, "band"]
    pool = ranking.limited(ranking.banded(pool, list(options.prefer)), 2 * OVERFETCH * options.limit)
    pool = pool.drop("input_pos").withColumnRenamed("rank_pos", "input_pos").drop("band")
    if hits is not None:
        pool, stages = store.merged(pool, hits), [*stages, "corpus"]
    if options.bm25:
        pool = ranking.bm25(pool, queries, options.recency, as_of)
        stages = [*stages, "bm25", *["recency"] * (options.recency > 0)]
    else:
        pool = pool.withColumn("rank_pos", F.col("input_pos"))
    if options.rerank and score is not None:
        pool = ranking.reranked(pool, score).drop("rank_pos").withColumnRenamed("rerank_pos", "rank_pos")
        stages = [*stages, "rerank"]
    if domains is not None:
        pool = ranking.poor_last(pool, domains).drop("rank_pos").withColumnRenamed("final_pos", "rank_pos")
        stages = [*stages, "domains"]
    return ranking.limited(pool, options.limit), stages


def search_and_fetch(queries: DataFrame, sources: list[DataFrame], pages: DataFrame, options: Options = Options(), limit: int = 3000, **more) -> tuple[DataFrame, list[str]]:
    """Search rows with the content of their pages; only the winners are extracted."""
    rows, stages = search(queries, sources, options, **more)
    content = fetching.offline(rows, pages, limit).select("url", "content", "quality", "tier", "failure_reason")
    return rows.join(content, "url", "left"), [*stages, "fetch"]


def response(rows: DataFrame) -> DataFrame:
    """(query_id, body): each query's rows as one JSON list in rank order."""
    own = [c for c in rows.columns if c != "query_id"]
    packed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank_pos", F.struct(*own).alias("row")))).alias("rows"))
    return packed.select("query_id", F.to_json(F.transform("rows", lambda x: x["row"])).alias("body"))


def with_telemetry(rows: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Attempts on the first row of each query only."""
    lists = telemetry.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("engine", "count", "status"))).alias("attempts"))
    joined = rows.join(lists, "query_id", "left")
    return joined.withColumn("attempts", F.when(F.col("rank_pos") == 1, F.col("attempts")))
