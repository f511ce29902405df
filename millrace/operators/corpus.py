"""The passage corpus: append, vector search, merge into a pool, retention, statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import scores, text

FLOOR, PER_URL, LIMIT = 0.22, 2, 10
KEEP_DAYS, MOST_ROWS = 180, 50_000


def passages(pages: DataFrame, model: str = "default") -> DataFrame:
    """(id, url, model, i, title, text) of every passage of pages (url, title, text)."""
    cut = pages.select("url", "title", text.passages(F.col("text"), F.col("title")).alias("__all")).select("url", "title", F.posexplode("__all").alias("i", "text"))
    return cut.select(scores.passage_id(F.col("url"), F.lit(model), F.col("i")).alias("id"), "url", F.lit(model).alias("model"), "i", text.text_of(F.col("title")).alias("title"), "text")


def unstored(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Passages whose id the corpus lacks: the first text of a place stays."""
    return found.join(corpus.select("id"), "id", "left_anti").dropDuplicates(["id"])


#: Query vectors of a block; each block is sent to every task of its own pass over the corpus.
MOST_QUERIES = 4096


def similar(corpus: DataFrame, queries: DataFrame, floor: float = FLOOR, per_url: int = PER_URL, limit: int = LIMIT, domains: list[str] | None = None, vec: str = "vec", model: str | None = None) -> DataFrame:
    """(query_id, id, url, score, rank_pos): the nearest passages above the floor, few per url.

    model: only passages of this model are compared, as vectors of different models share no space.
    queries: (query_id, vec), any number, taken in blocks of MOST_QUERIES; beyond one block they are read
    partition by partition, and only the block at hand is held by the driver. Scores come from one matrix
    product per Arrow batch and block; each task returns only rows that can still be among its own best,
    so what is shuffled is bounded by tasks x queries x limit x urls, not by the corpus.
    """
    if model is not None:
        corpus = corpus.filter(F.col("model") == model)
    wanted = queries.select("query_id", "vec")
    first = wanted.limit(MOST_QUERIES + 1).collect()
    blocks = [first] if len(first) <= MOST_QUERIES else _blocks(wanted.toLocalIterator())
    if domains:
        test = F.lit(False)
        for d in domains:
            test |= F.contains(F.lower("url"), F.lit(d.lower()))
        corpus = corpus.filter(test)
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, url {corpus.schema['url'].dataType.simpleString()}, score double"

    rows, found = corpus.select("id", "url", F.col(vec)).filter(F.col(vec).isNotNull()), []
    for block in blocks:
        sent = corpus.sparkSession.sparkContext.broadcast(([x["query_id"] for x in block], np.array([x["vec"] for x in block], np.float64).T))
        found.append(rows.mapInArrow(_scorer(sent, floor, per_url, limit), kind))
    while len(found) > 1:  # a balanced tree, so many blocks make no deep plan
        found = [a.unionByName(b) for a, b in zip(found[::2], found[1::2], strict=False)] + found[len(found) & ~1 :]
    each = Window.partitionBy("query_id", "url").orderBy(F.col("score").desc(), "id")
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    capped = found[0].withColumn("n", F.row_number().over(each)).filter(F.col("n") <= per_url).drop("n")
    return capped.withColumn("rank_pos", F.row_number().over(top)).filter(F.col("rank_pos") <= limit)


def _blocks(rows: Iterator) -> Iterator[list]:
    while block := list(islice(rows, MOST_QUERIES)):
        yield block


def _scorer(sent, floor: float, per_url: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for batch in batches:
            if not len(batch) or not names:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = flat.reshape(len(batch), -1) @ matrix
            row, query = np.nonzero(score >= floor)
            order = np.lexsort((row, -score[row, query], query))
            row, query = row[order], query[order]
            best = score[row, query]
            kept = _leaders(query, best, batch.column(1).to_pylist(), row, per_url, limit)
            at = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query[kept]]), batch.column(0).take(at), batch.column(1).take(at), pa.array(best[kept])], names=["query_id", "id", "url", "score"])

    return run


def _leaders(query, best, urls, row, per_url: int, limit: int) -> list[int]:
    """Places (sorted by query, best first) that may still win; ties with the last place stay in."""
    kept, now = [], None
    for k, (q, score) in enumerate(zip(query.tolist(), best.tolist(), strict=True)):
        if q != now:
            now, lows, counts, n, edge = q, {}, {}, 0, 0.0
        url = urls[row[k]]
        if (n >= limit and score < edge) or (counts.get(url, 0) >= per_url and score < lows[url]):
            continue
        counts[url], lows[url] = counts.get(url, 0) + 1, score if counts.get(url, 0) < per_url else lows[url]
        if n < limit and counts[url] <= per_url:
            n, edge = n + 1, score
        kept.append(k)
    return kept


def merged(pool: DataFrame, hits: DataFrame) -> DataFrame:
    """pool with the corpus hits whose url it lacks, behind its own rows."""
    fresh = hits.join(pool.select("query_id", "url"), ["query_id", "url"], "left_anti")
    last = pool.groupBy("query_id").agg(F.max("input_pos").alias("__last"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "url")
    rows = fresh.join(last, "query_id", "left").withColumn("input_pos", F.coalesce("__last", F.lit(0)) + F.row_number().over(order))
    rows = rows.withColumn("snippet", F.substring(text.text_of(F.col("text")), 1, 240)).withColumn("engine", F.lit("corpus")).withColumn("from_corpus", F.lit(True)).drop("__last")
    return pool.withColumn("from_corpus", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def retained(corpus: DataFrame, as_of: Column, days: int = KEEP_DAYS, most: int = MOST_ROWS) -> DataFrame:
    """Passages young enough, and of each model the newest ``most``.

    The cut is found from counts per timestamp, so only a model's distinct timestamps are sorted, and
    rows meet in one place only where a timestamp itself straddles the cut.
    """
    young = corpus.filter(F.unix_micros("ts") >= F.unix_micros(as_of) - F.lit(days * 86400 * 1_000_000))
    sizes = young.groupBy("model", "ts").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("model").orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, -1))
    room = sizes.withColumn("__room", F.lit(most) - F.coalesce(before, F.lit(0))).filter("__room > 0")
    rows = young.join(room, ["model", "ts"])
    whole = rows.filter(F.col("__n") <= F.col("__room"))
    part = rows.filter(F.col("__n") > F.col("__room")).withColumn("__k", F.row_number().over(Window.partitionBy("model", "ts").orderBy("id"))).filter(F.col("__k") <= F.col("__room")).drop("__k")
    return whole.unionByName(part).select(*corpus.columns)


def prune_counts(corpus: DataFrame, as_of: Column, days: int = KEEP_DAYS, most: int = MOST_ROWS) -> DataFrame:
    """(model, expired, total, over): what retained() drops by age, what is left before the cap, and what
    the cap drops. One partial aggregation; no row is sorted."""
    young = F.unix_micros("ts") >= F.unix_micros(as_of) - F.lit(days * 86400 * 1_000_000)
    counts = corpus.groupBy("model").agg(F.count_if(~young).alias("expired"), F.count_if(young).alias("total"))
    return counts.withColumn("over", F.greatest(F.col("total") - most, F.lit(0)))


def statistics(corpus: DataFrame) -> DataFrame:
    """(model, passages, urls)."""
    return corpus.groupBy("model").agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("url").alias("urls"))


def packed(vectors: Column) -> Column:
    """A vector as JSON text, the portable form; see unpacked()."""
    return F.to_json(vectors)


def unpacked(value: DataFrame, column: str) -> DataFrame:
    """vec from stored bytes (little-endian float32) or JSON text; null where neither reads."""
    @F.pandas_udf("array<float>")
    def read(raw: pd.Series) -> pd.Series:
        def one(x):
            try:
                if x[:1] == b"[":
                    return [float(v) for v in json.loads(x)]
                return np.frombuffer(x, "<f4").tolist() if len(x) % 4 == 0 else None
            except (TypeError, ValueError):
                return None

        return raw.map(one)

    return value.withColumn("vec", read(F.col(column).cast("binary")))
