"""Labelled documents for the classifiers: all of them, or bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import bloom, scan
from ._spark import BROADCAST_ROWS


def held_out() -> Column:
    """True for the fifth of the documents that no classifier learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out()).dropDuplicates(["doc_id"])


def rows(docs: DataFrame, labels: DataFrame, label: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, *extra, y) of every labelled row that is not held out, and the labels kept on disk
    for it, which the caller gives back by unpersist().

    A short list of labels is broadcast; of a long one a Bloom filter is, and only rows that may be in it
    are shuffled with their texts.
    """
    known = _known(labels, label).persist(StorageLevel.DISK_ONLY)
    count = known.count()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    if count <= BROADCAST_ROWS:
        return found.join(F.broadcast(known), "doc_id"), known
    words = docs.sparkSession.sparkContext.broadcast(bloom.build(known, "doc_id", count))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(bloom.test(words.value, key.to_numpy()))

    return found.filter(maybe(F.coalesce("doc_id", F.lit(0).cast("long")))).join(known, "doc_id"), known


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, y, *extra) of at most ``most`` rows a class, none of them held out.

    The rows with the smallest keyed hashes of their doc_id are taken, so the sample is spread over
    the corpus and stays the same when other rows come; ``most`` bounds what is broadcast.
    """
    known = _known(labels, label)
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    picked = known.filter("y = 0").orderBy(*order).limit(most).unionByName(known.filter("y = 1").orderBy(*order).limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    return rows.join(F.broadcast(picked), "doc_id")


def with_score(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(row, score): every row of docs as a struct, so that no column name can clash."""
    kind = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                row = batch.column(0)
                offsets, data = scan.buffers(row.field("text"))
                for a, b in scan.slices(offsets):
                    yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pa.array(score(offsets[a : b + 1], data))], names=["row", "score"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).mapInArrow(run, kind)
