"""Continuous forms: indexing of fetched rows, rolling budgets, cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import corpus as store

BODY = 4000


def harvest(fetched: DataFrame) -> DataFrame:
    """(url, title, text) of rows worth indexing: prose that came out well."""
    good = fetched.filter((F.col("quality") == "ok") & (F.length("content") > 0))
    return good.select("url", "title", F.substring("content", 1, BODY).alias("text"))


def indexer(path: str, model: str = "default"):
    """A foreachBatch sink that appends unknown passages to the corpus at path.

    Each micro-batch writes a folder of its own and overwrites it when it is run again, so a retried
    batch adds nothing twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = store.passages(harvest(batch), model).withColumn("ts", F.current_timestamp())
        try:
            known = spark.read.parquet(path).filter(F.col("batch") != epoch).select("id")
            fresh = store.unstored(fresh, known)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            fresh = fresh.dropDuplicates(["id"])
        fresh.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def budget(log: DataFrame, most: int, window: float = 3600.0) -> DataFrame:
    """A stream (tier, at seconds, seq) with granted, by keyed state of at most ``most`` times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame, out = frame.sort_values(["at", "seq"]), []
            for at in frame["at"]:
                used = [t for t in used if at - t < window]
                out.append(len(used) < most)
                if out[-1]:
                    used.append(float(at))
            yield pd.DataFrame({"tier": key[0], "at": frame["at"], "seq": frame["seq"], "granted": out})
        state.update((used,))

    return log.groupBy("tier").applyInPandasWithState(run, "tier string, at double, seq long, granted boolean", "used array<double>", "append", GroupStateTimeout.NoTimeout)


def cooldown(log: DataFrame) -> DataFrame:
    """A stream (tier, at seconds, seq, refused) with strikes and until: rest grows with refusals in a row."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes = state.get[0] if state.exists else 0
        for frame in frames:
            frame, n, until = frame.sort_values(["at", "seq"]), [], []
            for at, refused in zip(frame["at"], frame["refused"], strict=True):
                strikes = strikes + 1 if refused else 0
                n.append(strikes)
                until.append(float(at) + min(300.0 * 2 ** min(strikes - 1, 20), 3600.0) if strikes else 0.0)
            yield pd.DataFrame({"tier": key[0], "at": frame["at"], "seq": frame["seq"], "strikes": n, "until": until})
        state.update((strikes,))

    return log.groupBy("tier").applyInPandasWithState(run, "tier string, at double, seq long, strikes long, until double", "strikes long", "append", GroupStateTimeout.NoTimeout)
