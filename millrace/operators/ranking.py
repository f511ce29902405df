"""Ranking of result pools: BM25, recency, bands, poor domains last, shortlist reranking.

A pool is the rows of one query_id; one job ranks any number of pools. Ties keep the input order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import scores, text, urls

# Domains that free sources surface without bearing on the question.
JUNK_DOMAINS = (
    "incometax.gov.in 247wallst.com fool.com investorplace.com zacks.com benzinga.com marketbeat.com tipranks.com "
    "simplywall.st stocktwits.com insidermonkey.com gurufocus.com barchart.com investing.com tradingview.com"
).split()
SHORTLIST = 40


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, term, w): tokens of over two letters; w counts repeats."""
    exploded = queries.select("query_id", F.explode(text.tokens(F.col(query))).alias("term"))
    return exploded.filter(F.length("term") > 2).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("w"))


def bm25(pool: DataFrame, queries: DataFrame, recency: float = 0.0, as_of: Column | None = None, half_life: float = 21.0) -> DataFrame:
    """pool (query_id, input_pos, title, text, published) with score and rank_pos.

    Rows that match nothing score 0 and stay. Texts are read twice, for the pool's statistics and for the
    scores: each row keeps only its length and the counts of its query's terms, so what the statistics
    shuffle is small however long the texts are. The
    terms of a query ride along as one array; the number of queries' rows bounds that table.
    """
    terms = query_terms(queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    tokens = text.tokens(text.ranking_text(F.col("title"), F.col("text")))
    rows = pool.withColumn("__tokens", tokens).join(terms, "query_id", "left")
    counts = F.transform(F.col("terms"), lambda t: F.size(F.filter(F.col("__tokens"), lambda x: x == t["term"])))
    rows = rows.withColumn("__tf", counts).withColumn("__len", F.size("__tokens")).drop("__tokens")
    # one small row of statistics per query, from one pass over the texts; no row of the pool meets another
    seen = rows.select("query_id", "__len", F.posexplode_outer("__tf").alias("i", "tf")).groupBy("query_id", "i")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.avg("__len").alias("mean"), F.sum((F.col("tf") > 0).cast("int")).alias("df"))
    entry = F.when(F.col("i").isNotNull(), F.struct("i", "df"))
    df = seen.groupBy("query_id").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.map_from_entries(F.collect_list(entry)).alias("df"))
    rows = rows.join(df, "query_id")
    norm = 0.25 + 0.75 * F.greatest(F.col("__len"), F.lit(1)) / F.col("mean")

    def part(tf: Column, i: Column) -> Column:
        seen = F.greatest(F.coalesce(F.element_at("df", i), F.lit(1)), F.lit(1)).cast("double")
        idf = F.log(1 + (F.col("n") - seen + 0.5) / (seen + 0.5))
        w = F.get(F.col("terms"), i)["w"]
        return F.when(tf > 0, w * idf * (tf * 2.5) / (tf + 1.5 * norm)).otherwise(0.0)

    score = F.coalesce(F.aggregate(F.transform(F.col("__tf"), part), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    if recency > 0:
        score = score * scores.freshness(scores.age_days(F.col("published"), as_of), recency, half_life)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "input_pos")
    return rows.withColumn("score", score).withColumn("rank_pos", F.row_number().over(order)).select(*pool.columns, "score", "rank_pos")


def band(url: Column, prefer: list[str]) -> Column:
    """0 for preferred domains and their subdomains, 2 for junk, 1 for all others."""
    domain = urls.search_domain(url)
    own = F.lit(False)
    for p in sorted({x.lower() for x in prefer}):
        own |= (domain == p) | domain.endswith("." + p)
    return F.when(domain.isin(*JUNK_DOMAINS), 2).when(own, 0).otherwise(1)


def banded(pool: DataFrame, prefer: list[str]) -> DataFrame:
    """pool with band and rank_pos: preferred first, junk last, input order inside a band."""
    order = Window.partitionBy("query_id").orderBy("band", "input_pos")
    return pool.withColumn("band", band(F.col("url"), prefer)).withColumn("rank_pos", F.row_number().over(order))


def without_junk(pool: DataFrame) -> DataFrame:
    return pool.filter(~urls.search_domain(F.col("url")).isin(*JUNK_DOMAINS))


def poor_last(pool: DataFrame, domains: DataFrame) -> DataFrame:
    """pool with rank_pos moved so that domains of bad record come last; domains: (domain, is_poor)."""
    known = domains.select(F.col("domain").alias("__domain"), "is_poor")
    rows = pool.withColumn("__domain", urls.health_domain(F.col("url"))).join(known, "__domain", "left")
    poor = F.coalesce(F.col("is_poor"), F.lit(False))
    order = Window.partitionBy("query_id").orderBy(poor, "rank_pos")
    return rows.withColumn("is_poor", poor).withColumn("final_pos", F.row_number().over(order)).drop("__domain")


def reranked(pool: DataFrame, score: Callable[[Column], Column] | None, shortlist: int = SHORTLIST) -> DataFrame:
    """The first rows of each pool by a model's score of (title + 400 characters), the tail as it was.

    score: makes a Column from the text, such as a pandas UDF that loads its model once per worker;
    None (no model here) leaves the order. Only the shortlist reaches it: it is split off first.
    """
    if score is None:
        return pool.withColumn("rerank_pos", F.col("rank_pos"))
    head = pool.filter(F.col("rank_pos") <= shortlist).withColumn("__s", score(text.ranking_text(F.col("title"), F.coalesce("text", "snippet"), 400)))
    tail = pool.filter(F.col("rank_pos") > shortlist)
    order = Window.partitionBy("query_id").orderBy(F.col("__s").desc(), "rank_pos")
    return head.withColumn("rerank_pos", F.row_number().over(order)).drop("__s").unionByName(tail.withColumn("rerank_pos", F.col("rank_pos")))


def limited(pool: DataFrame, limit: int, position: str = "rank_pos") -> DataFrame:
    """The first rows of each pool."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return pool.filter(F.col(position) <= limit)


def trusted_share(pool: DataFrame, trusted: list[str], threshold: float = 0.35) -> DataFrame:
    """(query_id, share, sweep): whether a pool is short of trusted publishers."""
    domain, own = urls.search_domain(F.col("url")), F.lit(False)
    for p in trusted:
        own |= (domain == p) | domain.endswith("." + p)
    return pool.groupBy("query_id").agg(F.avg(own.cast("double")).alias("share")).withColumn("sweep", F.col("share") < threshold)
