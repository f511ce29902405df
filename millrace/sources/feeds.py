"""Search sources as payloads: RSS and JSON bodies into the common row schema.

Fetching needs a network and is left to a caller's reader (see plans.fetch.Tier); what comes back is
parsed here with native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text, urls

ROW = ("title", "url", "snippet", "content", "publishedDate", "engine", "source")


def normalised(rows: DataFrame, engine: str) -> DataFrame:
    """Missing fields as empty text; the source falls back to the domain."""
    have = set(rows.columns)
    out = {c: text.text_of(F.col(c)) if c in have else F.lit("") for c in ROW}
    out["engine"] = F.lit(engine)
    domain = urls.search_domain(out["url"])
    out["source"] = F.coalesce(F.nullif(out["source"], F.lit("")), domain)
    return rows.select(*[c for c in rows.columns if c not in ROW], *[v.alias(k) for k, v in out.items()])


def _items(body: Column) -> Column:
    return F.regexp_extract_all(text.text_of(body), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))


def _field(item: Column, name: str) -> Column:
    raw = F.regexp_extract(item, rf"(?s)<{name}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.trim(raw)


def news(feeds: DataFrame, most: int = 8) -> DataFrame:
    """Rows of news feeds (query_id, body): redirects unwrapped, tags cut, the feed's own pages left out."""
    rows = feeds.select("query_id", F.posexplode(F.slice(_items(F.col("body")), 1, most)).alias("input_pos", "item"))
    rows = rows.select("query_id", "input_pos", _field(F.col("item"), "title").alias("title"), urls.unwrapped(_field(F.col("item"), "link")).alias("url"), text.without_tags(_field(F.col("item"), "description")).alias("snippet"), _field(F.col("item"), "pubDate").alias("publishedDate"))
    good = (F.col("url") != "") & (F.col("title") != "") & ~urls.search_domain(F.col("url")).endswith("bing.com")
    return normalised(rows.filter(good), "bing-news")


def headlines(feeds: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, input_pos, title, publisher, published) of headline feeds."""
    rows = feeds.select("query_id", F.posexplode(F.slice(_items(F.col("body")), 1, most)).alias("input_pos", "item"))
    title, publisher = text.headline(_field(F.col("item"), "title"))
    return rows.select("query_id", "input_pos", title.alias("title"), publisher.alias("publisher"), _field(F.col("item"), "pubDate").alias("published")).filter("title <> ''")


_JSON = "struct<results:array<struct<title:string,url:string,content:string,publishedDate:string,engine:string>>,unresponsive_engines:array<array<string>>>"


def metasearch(bodies: DataFrame, most: int = 8) -> DataFrame:
    """Rows of JSON answers (query_id, body): the first ``most``, then those with a url."""
    parsed = bodies.withColumn("__j", F.from_json("body", _JSON))
    rows = parsed.select("query_id", F.posexplode(F.slice("__j.results", 1, most)).alias("input_pos", "r"))
    rows = rows.select("query_id", "input_pos", "r.title", "r.url", F.col("r.content").alias("snippet"), F.col("r.publishedDate").alias("publishedDate"))
    return normalised(rows.filter("url <> ''"), "searxng")


def unresponsive(bodies: DataFrame) -> DataFrame:
    """(query_id, engine, reason) of engines that a JSON answer names as silent."""
    parsed = bodies.withColumn("__j", F.from_json("body", _JSON))
    rows = parsed.select("query_id", F.explode("__j.unresponsive_engines").alias("x"))
    return rows.select("query_id", F.get("x", F.lit(0)).alias("engine"), F.substring(F.coalesce(F.get("x", F.lit(1)), F.lit("")), 1, 80).alias("reason"))


def sweep_queries(queries: DataFrame, domains: list[str], most: int = 4) -> DataFrame:
    """(query_id, query, domain): one ``site:`` query for up to four trusted domains, rotated by query."""
    if not domains:
        return queries.select("query_id", "query", F.lit("").alias("domain")).limit(0)
    order = sorted({x.lower() for x in domains})
    offset = F.pmod(F.crc32("query"), F.lit(len(order))).cast("int")
    names = F.array(*[F.lit(x) for x in order * 2])
    rows = queries.withColumn("__d", F.slice(names, offset + 1, F.lit(min(most, len(order)))))
    return rows.select("query_id", F.explode("__d").alias("domain"), "query").withColumn("query", F.concat(F.lit("site:"), F.col("domain"), F.lit(" "), F.col("query")))


def on_domain(rows: DataFrame) -> DataFrame:
    """Sweep rows (domain, url) that lie on the domain asked for, or below it."""
    own = urls.search_domain(F.col("url"))
    return rows.filter((own == F.col("domain")) | F.endswith(own, F.concat(F.lit("."), F.col("domain"))))
