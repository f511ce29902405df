"""Order-sensitive deduplication of result pools."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from millrace.functions import text, urls

LEAST_TITLE = 25


def by_url(pool: DataFrame) -> DataFrame:
    """The first row of each canonical address in a pool."""
    key = urls.canonical_url(F.col("url"))
    order = Window.partitionBy("query_id", "__key").orderBy("input_pos")
    return pool.withColumn("__key", key).filter(F.col("__key") != "").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__key", "__n")


def greedy(pool: DataFrame) -> DataFrame:
    """In arrival order, rows whose canonical address and (long) title key are both new.

    A row refused for its title does not register its address, so the outcome depends on order and is
    found in one pass over a pool. Rows are sorted by Spark and streamed; a worker holds one pool's
    keys, not its rows. Exact repeats of a row's (address, title) are dropped before the shuffle's
    sort, where they cannot change the outcome.
    """
    keyed = pool.withColumn("__key", urls.canonical_url(F.col("url"))).withColumn("__title", text.title_key(F.col("title"))).filter(F.col("__key") != "")
    slim = keyed.groupBy("query_id", "__key", "__title").agg(F.min("input_pos").alias("input_pos"))
    dealt = slim.repartition("query_id").sortWithinPartitions("query_id", "input_pos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, titles = None, set(), set()
        for frame in frames:
            kept = []
            for query, key, title in zip(frame["query_id"], frame["__key"], frame["__title"], strict=True):
                if query != now:
                    now, seen, titles = query, set(), set()
                long = len(title) >= LEAST_TITLE
                good = key not in seen and not (long and title in titles)
                if good:
                    seen.add(key)
                    if long:
                        titles.add(title)
                kept.append(good)
            yield frame.loc[kept, ["query_id", "input_pos"]]

    first = dealt.mapInPandas(run, f"query_id {pool.schema['query_id'].dataType.simpleString()}, input_pos {pool.schema['input_pos'].dataType.simpleString()}")
    return pool.join(first, ["query_id", "input_pos"], "left_semi")


def merged(sources: list[DataFrame]) -> DataFrame:
    """Sources in order as one pool: input_pos runs over source, then the source's own order."""
    out = None
    for k, source in enumerate(sources):
        rows = source.withColumn("source_pos", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy("source_pos", "input_pos")
    return out.withColumn("input_pos", F.row_number().over(order)).drop("source_pos")


def capped(rows: DataFrame, group: str, most: int, *order) -> DataFrame:
    """At most so many rows of a group, best first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def unknown_titles(rows: DataFrame, pool: DataFrame, most: int = 3) -> DataFrame:
    """Headlines of a query whose title key the pool lacks, the first few of each."""
    known = pool.select("query_id", text.title_key(F.col("title")).alias("__title"))
    fresh = rows.withColumn("__title", text.title_key(F.col("title"))).filter(F.col("__title") != "").join(known, ["query_id", "__title"], "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__title").orderBy("input_pos"))).filter("__n = 1")
    return first.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("input_pos"))).filter(F.col("__n") <= most).drop("__n", "__title")


def cut_by_size(rows: DataFrame, group: str, position: str, column: str, limit: int) -> DataFrame:
    """Rows of a group in order until their text has reached the limit; the row that reaches it stays."""
    before = F.sum(F.length(column)).over(Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < limit).drop("__before")
