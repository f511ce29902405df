"""Helpers of the training-data operators: shared folder, staged tables, skew-proof joins.

Executors share no local folder, so every intermediate table goes below the folder named by
``spark.checkpoint.dir``. Where that setting is missing, a local session gets a folder of its own, and
a cluster an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows in an Arrow batch of whole texts: Spark's default of 10,000 may be hundreds of megabytes.
BATCH_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package also when they start in another folder, and keep batches
    of whole texts small, unless the session's own setting is smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or a path."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by new_folder()."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a staged file of narrow rows.
FILE_ROWS = 200_000


def _files(spark: SparkSession, rows: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, rows // FILE_ROWS)


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing.

    rows: about how many narrow rows come, where that is known: then files of FILE_ROWS rows are
    written, two for each core at least, and not one for every partition of the last shuffle.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if rows is not None:
        df = df.coalesce(_files(spark, rows))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


#: Types that written() writes as Spark reads them.
_PLAIN = {"bigint", "int", "double", "boolean", "string", "array<bigint>"}
#: Bytes of Arrow batches that written() gathers into one row group.
GROUP_BYTES = 8 << 20


#: False: written() is staged().
BY_WORKERS = ContextVar("by_workers", default=True)
#: Spark removes an execution's shuffle files when it ends, and not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _writer(path: str, made=None):
    """Write a task's rows, or those that made() makes of them, to one hidden file of its own below path;
    a row names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = opened(path)
        name, out, held, total = f"_{uuid.uuid4().hex}.parquet", None, [], 0
        for batch in made(batches) if made else batches:
            if not len(batch):
                continue
            out = out or pyarrow.parquet.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=files)
            held.append(batch)
            total += batch.nbytes
            if total >= GROUP_BYTES:
                out.write_table(pa.Table.from_batches(held))
                held, total = [], 0
        if out is not None:
            if held:
                out.write_table(pa.Table.from_batches(held))
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def written(df: DataFrame, name: str, rows: int | None = None, made=None, schema: str | None = None) -> DataFrame:
    """staged() for narrow rows, by Python workers where the shared folder is a plain one.

    made, schema: as for mapInArrow(), of which the rows are written by the worker that makes them.
    There Hadoop's client starts two ``chmod`` processes for every file that it makes, and each counts with
    all the memory of the executor's JVM until its program runs. Files are hidden until their task has
    succeeded, so what a failed or doubled attempt leaves is not read. Other stores and types go by staged(), as does
    everything while BY_WORKERS is False.
    """
    spark = df.sparkSession
    out = df.mapInArrow(made, schema) if made else df
    path = new_folder(spark, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    local = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    if not BY_WORKERS.get() or not local or not {kind for _, kind in out.dtypes} <= _PLAIN:
        return staged(out, name, rows)
    if rows is not None:
        df = df.coalesce(_files(spark, rows))
    files, folder = opened(path)
    files.create_dir(folder, recursive=True)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        names = df.mapInArrow(_writer(path, made), "name string").collect()
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    for row in names:
        files.move(f"{folder}/{row.name}", f"{folder}/part-{row.name[1:]}")
    out = spark.read.schema(out.schema).parquet(path)
    out._staged_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables, once everything that was made of them is staged itself."""
    for df in tables:
        if df is not None and (path := getattr(df, "_staged_at", None)):
            remove(df.sparkSession, path)


#: Narrow rows that may be broadcast, once counted: some 10 MB.
BROADCAST_ROWS = 100_000


#: How many narrow rows a wide one, of packed signatures, counts for.
WIDE = 8


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than BROADCAST_ROWS rows, else as it is.

    Without the hint Spark shuffles both sides before it finds one small: three exchanges, not one.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def opened(path: str):
    """(file system, path) of a URI or a plain path; executors reach the store through its own client."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot when it holds at least this share of all rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 512


def hot_groups(groups: DataFrame, total: int, size: str = "group_size") -> DataFrame:
    """The groups that hold HOT_SHARE of all rows or more: never over 1/HOT_SHARE rows."""
    return groups.filter(F.col(size) >= F.lit(max(2, int(total * HOT_SHARE))))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], values: Sequence[str], total: int, spread: Column, how: str = "left") -> DataFrame:
    """rows joined to one row per key of ``groups`` (columns keys + values + group_size).

    The few hot groups (at most 1/HOT_SHARE of them) are broadcast; their rows are dealt out by
    ``spread`` and meet nothing in the shuffle join that serves all other groups. Of no more than
    BROADCAST_ROWS rows all groups are broadcast, in one exchange.
    """
    if total <= BROADCAST_ROWS:
        named = groups.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"__v_{v}") for v in values])
        met = rows.join(F.broadcast(named), [rows[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)], how)
        return met.select(*[c for c in rows.columns if c not in values], *[F.col(f"__v_{v}").alias(v) for v in values])
    hot = hot_groups(groups, total).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__hot"))
    cold = groups.filter(F.col("group_size") < F.lit(max(2, int(total * HOT_SHARE)))).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(0).cast("long").alias("__spread"), *[F.col(v).alias(f"__c_{v}") for v in values], F.lit(True).alias("__cold"))
    on = lambda left, right: [left[k].eqNullSafe(right[f"__k{i}"]) for i, k in enumerate(keys)]
    if how == "inner":  # rows of no group leave at once
        drop = [*(f"__k{i}" for i in range(len(keys))), "__hot"]
        one = rows.join(F.broadcast(hot), on(rows, hot)).drop(*drop).withColumnsRenamed({f"__h_{v}": v for v in values})
        rest = rows.join(F.broadcast(hot), on(rows, hot), "left_anti")
        two = rest.join(cold, on(rest, cold)).drop(*drop, "__spread", "__cold").withColumnsRenamed({f"__c_{v}": v for v in values})
        return one.unionByName(two)
    a = rows.join(F.broadcast(hot), on(rows, hot), "left").drop(*[f"__k{i}" for i in range(len(keys))])
    a = a.withColumn("__salt", F.when(F.col("__hot"), F.lit(1).cast("long") + F.abs(spread % F.lit(1 << 20))).otherwise(F.lit(0).cast("long")))
    b = a.join(cold, [*on(a, cold), a["__salt"] == cold["__spread"]], "left")
    keep = [c for c in rows.columns if c not in values]
    return b.select(*keep, *[F.when(F.col("__hot"), F.col(f"__h_{v}")).otherwise(F.col(f"__c_{v}")).alias(v) for v in values])
