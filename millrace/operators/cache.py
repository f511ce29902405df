"""The page cache as a table (kind, key, value, ts): last write wins, entries expire by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import scores

# Seconds that entries of a kind stay good.
TTL = {"search": 6 * 3600, "extract": 21 * 24 * 3600, "fetch": 21 * 24 * 3600, "robots": 24 * 3600}
OTHER_TTL, PURGE_DAYS, STORED = 3600, 30, 20_000


def ttl(kind: Column) -> Column:
    out = F.lit(OTHER_TTL)
    for name, seconds in TTL.items():
        out = F.when(kind == name, F.lit(seconds)).otherwise(out)
    return out


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each key; seq breaks ties of ts. One partial aggregation."""
    rest = [c for c in entries.columns if c not in ("kind", "key", "ts", "seq")]
    last = entries.groupBy("kind", "key").agg(F.max(F.struct("ts", "seq", *rest)).alias("x"))
    return last.select("kind", "key", "x.ts", "x.seq", *[F.col(f"x.{c}") for c in rest])


def fresh(entries: DataFrame, as_of: Column, override: float | None = None) -> DataFrame:
    """Entries within their time to live; a negative override never expires."""
    if override is not None and override < 0:
        return entries
    limit = ttl(F.col("kind")) if override is None else F.lit(override)
    return entries.filter((F.unix_micros(as_of) - F.unix_micros("ts")) / 1e6 <= limit)


def lookup(requests: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """requests (kind, key) with value and hit; a value that is no JSON is a miss."""
    good = fresh(latest(entries), as_of).filter(F.try_parse_json("value").isNotNull()).select("kind", "key", "value")
    return requests.join(good, ["kind", "key"], "left").withColumn("hit", F.col("value").isNotNull())


def hit_rate(looked_up: DataFrame) -> DataFrame:
    """(hits, total, rate) with rate 0 when nothing was asked."""
    rows = looked_up.agg(F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("rate", F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 3))


def statistics(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))


def purged(entries: DataFrame, as_of: Column, days: int = PURGE_DAYS) -> DataFrame:
    return entries.filter(F.unix_micros("ts") >= F.unix_micros(as_of) - F.lit(days * 86400 * 1_000_000))


def writable(results: DataFrame) -> DataFrame:
    """What fetch results leave in the cache: successes only, without source markup."""
    rows = results.filter("ok").drop("html")
    value = F.to_json(F.struct(*[F.substring("text", 1, STORED).alias("text") if c == "text" else F.col(c) for c in rows.columns]))
    return rows.select(F.lit("extract").alias("kind"), scores.cache_key(F.lit("extract"), F.col("url")).alias("key"), value.alias("value"))
