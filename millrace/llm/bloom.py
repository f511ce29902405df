"""A Bloom filter of bounded size: saves shuffling rows that a join would not touch, decides nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import scan
from ._spark import BROADCAST_ROWS

#: Bits at most, whatever the input: 4 MB. A fuller filter only lets more rows through to the join.
MOST_BITS = 1 << 25
_KEYS = 3


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return [(scan.mix(x + scan.stream(k + 900, 1)) & np.uint64(bits - 1)).astype(np.int64) for k in range(_KEYS)]


def build(df: DataFrame, column: str, count: int) -> np.ndarray:
    """The filter's 64-bit words; at most MOST_BITS / 64 rows reach the driver, whatever the input."""
    bits = 1 << 16
    while bits < MOST_BITS and bits < 16 * count:
        bits *= 2

    def run(frames):
        for x in frames:
            if len(x):
                at = np.unique(np.concatenate(_places(x["id"].to_numpy(), bits)))
                words, first = np.unique(at >> 6, return_index=True)
                ones = np.uint64(1) << (at & 63).astype(np.uint64)
                yield pd.DataFrame({"w": words, "m": np.bitwise_or.reduceat(ones, first).view(np.int64)})

    rows = df.select(df[column].alias("id")).mapInPandas(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return out


def test(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False: surely not in the filter."""
    out = np.ones(len(ids), bool)
    for at in _places(ids, 64 * len(words)):
        out &= (words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def _named(docs: DataFrame, mark: Column) -> DataFrame:
    """(row, id, mark): whole rows as structs, so that no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))


def _maybe(names: DataFrame, count: int) -> Column:
    """Whether a row's (id, mark) may be among the names (doc_id, mark)."""
    words = names.sparkSession.sparkContext.broadcast(build(names.select(F.xxhash64("doc_id", "mark").alias("key")), "key", count))

    @F.pandas_udf("boolean")
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(test(words.value, key.to_numpy()))

    return run(F.xxhash64("id", "mark"))


def _on(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, Column]:
    names = names.select(F.col("doc_id").alias("name_id"), F.col("mark").alias("name_mark"))
    return names, rows["id"].eqNullSafe(names["name_id"]) & (rows["mark"] == names["name_mark"])


def rows_left(docs: DataFrame, gone: DataFrame, mark: Column, count: int) -> DataFrame:
    """docs, all columns as they are, without the rows whose doc_id and mark are in gone (doc_id, mark).

    count: rows of gone. A short list is broadcast; of a long one the filter is, and only rows that may be
    in it are shuffled with their texts.
    """
    rows = _named(docs, mark)
    if count <= BROADCAST_ROWS:
        names, on = _on(rows, gone)
        return rows.join(F.broadcast(names), on, "left_anti").select("row.*")
    rows = rows.withColumn("maybe", _maybe(gone, count))
    unsure = rows.filter("maybe")
    names, on = _on(unsure, gone)
    return rows.filter("not maybe").select("row.*").unionByName(unsure.join(names, on, "left_anti").select("row.*"))


def rows_named(docs: DataFrame, wanted: DataFrame, mark: Column, count: int) -> DataFrame:
    """(row, id, mark) of the rows whose doc_id and mark are in wanted (doc_id, mark)."""
    rows = _named(docs, mark)
    if count > BROADCAST_ROWS:
        rows = rows.filter(_maybe(wanted, count))
    names, on = _on(rows, wanted)
    return rows.join(F.broadcast(names) if count <= BROADCAST_ROWS else names, on, "left_semi")
