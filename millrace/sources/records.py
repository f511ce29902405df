"""Health records kept as JSON lines; what does not parse reads as absent. Tables are replaced whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

DOMAIN = "domain string, ok double, fail double, ts timestamp"
ENGINE = "engine string, at timestamp, reason string, fails long"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).select(parsed.alias("r")).filter(F.col("r._bad").isNull())
    return rows.select("r.*").drop("_bad")


def write(record: DataFrame, path: str) -> None:
    """Written aside and then renamed: a failed job leaves the old record as it was."""
    spark = record.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    record.write.json(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(aside), hadoop.Path(path)
    files = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{aside} could not be renamed to {path}")
