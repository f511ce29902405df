"""Fetch tiers and engines: cooldown, rest, budgets, politeness."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import scores

REST, WINDOW, GAP = 1800.0, 3600.0, 1.5


#: Seconds of the ranges that a long log of one key is cut into; ranges meet in one small row each.
RANGE = 3600


def strikes(log: DataFrame, keys: tuple[str, ...] = ("tier",)) -> DataFrame:
    """The log (tier, ts, seq, refused) with strikes: refusals in a row so far, cleared by an answer,
    and rest: seconds of cooldown that the row starts (0 for an answer).

    A tier's log is cut by the hour: rows are counted inside their hour, and only one row an hour is
    carried over to the next, so a tier is no single task however long its log is.
    """
    slot = F.coalesce(F.floor(F.unix_micros("ts") / F.lit(RANGE * 1_000_000)), F.lit(-(1 << 62)))
    here = Window.partitionBy(*keys, "__slot").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*keys, "__slot", "__run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("__slot", slot).withColumn("__run", F.sum((~F.col("refused")).cast("int")).over(here))
    rows = rows.withColumn("__own", F.sum(F.col("refused").cast("int")).over(inside))
    # an hour's row: whether it has an answer, and the refusals behind its last one
    hours = rows.groupBy(*keys, "__slot").agg((F.max("__run") > 0).cast("int").alias("__answers"), F.max_by("__own", F.struct("ts", "seq")).alias("__tail"))
    order = Window.partitionBy(*keys).orderBy("__slot")
    hours = hours.withColumn("__since", F.sum("__answers").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.sum("__tail").over(Window.partitionBy(*keys, "__since").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0))
    hours = hours.withColumn("__so_far", so_far).withColumn("__before", F.coalesce(F.lag("__so_far").over(order), F.lit(0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "__slot")]
    both = rows.alias("a").join(hours.select(*keys, "__slot", "__before").alias("b"), same).select("a.*", "b.__before")
    count = F.col("__own") + F.when(F.col("__run") == 0, F.col("__before")).otherwise(0)
    both = both.withColumn("strikes", F.when(F.col("refused"), count).otherwise(0))
    return both.withColumn("rest", F.when(F.col("refused"), scores.backoff(F.col("strikes"))).otherwise(0.0)).drop("__slot", "__run", "__own", "__before")


def resting(log: DataFrame, as_of: Column, restable: list | None = None) -> DataFrame:
    """(tier, strikes, until) of tiers still cooling; only restable tiers ever rest."""
    last = strikes(log if restable is None else log.filter(F.col("tier").isin(*restable)))
    newest = last.groupBy("tier").agg(F.max(F.struct("ts", "seq", "strikes", "rest")).alias("x"))
    until = F.timestamp_micros(F.unix_micros("x.ts") + (F.col("x.rest") * 1e6).cast("long"))
    return newest.select("tier", F.col("x.strikes").alias("strikes"), until.alias("until")).filter((F.col("strikes") > 0) & (as_of < F.col("until")))


def awake(tiers: DataFrame, cooling: DataFrame) -> DataFrame:
    return tiers.join(cooling.select("tier"), "tier", "left_anti")


def failures(log: DataFrame) -> DataFrame:
    """(engine, fails, at, reason): the record of failures (engine, ts, seq, reason)."""
    last = F.max(F.struct("ts", "seq", "reason"))
    return log.groupBy("engine").agg(F.count(F.lit(1)).alias("fails"), last.alias("x")).select("engine", "fails", F.col("x.ts").alias("at"), F.substring("x.reason", 1, 80).alias("reason"))


def rested(engines: DataFrame, record: DataFrame, as_of: Column, rest: float = REST) -> DataFrame:
    """Engines that are not resting; all of them where every one would rest. The list is short by
    nature: a handful of engines, one row each."""
    rows = engines.join(record.select("engine", "at"), "engine", "left")
    tired = F.coalesce((F.unix_micros(as_of) - F.unix_micros("at")) <= F.lit(int(rest * 1e6)), F.lit(False))
    rows = rows.withColumn("__tired", tired)
    alive = rows.agg(F.sum((~F.col("__tired")).cast("int")).alias("__alive"))
    return rows.crossJoin(F.broadcast(alive)).filter(~F.col("__tired") | (F.col("__alive") == 0)).select(*engines.columns)


def slots(requests: DataFrame, gap: float = GAP) -> DataFrame:
    """requests (domain, arrival seconds, seq) with start: the time at which politeness lets each go.

    Closed form of waiting for the one before: gap * n + the running maximum of arrival - gap * k. Both
    are taken inside an hour of a domain and carried over by one row an hour, as in strikes().
    """
    rows = requests.withColumn("__slot", F.coalesce(F.floor(F.col("arrival") / F.lit(RANGE)), F.lit(-(1 << 62))))
    here = Window.partitionBy("domain", "__slot").orderBy("arrival", "seq")
    before = Window.partitionBy("domain").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("domain", "__slot")]

    def carried(rows: DataFrame, value: Column, name: str, total) -> DataFrame:
        hours = rows.groupBy("domain", "__slot").agg(value.alias("__v")).select("domain", "__slot", total("__v").over(before).alias(name))
        return rows.alias("a").join(hours.alias("b"), same).select("a.*", f"b.{name}")

    rows = carried(rows, F.count(F.lit(1)), "__earlier", F.sum)
    rows = rows.withColumn("__n", F.coalesce("__earlier", F.lit(0)) + F.row_number().over(here) - 1)
    rows = carried(rows.withColumn("__free", F.col("arrival") - gap * F.col("__n")), F.max("__free"), "__high", F.max)
    lead = F.greatest(F.max("__free").over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("__high"))
    return rows.withColumn("start", gap * F.col("__n") + lead).drop("__slot", "__earlier", "__n", "__free", "__high")


def budget_used(log: DataFrame, as_of: Column, window: float = WINDOW) -> DataFrame:
    """(tier, used): requests within the window before as_of."""
    recent = (F.unix_micros(as_of) - F.unix_micros("ts")) < F.lit(int(window * 1e6))
    return log.groupBy("tier").agg(F.sum(recent.cast("int")).alias("used"))


def grants(log: DataFrame, budget: int, window: float = WINDOW) -> DataFrame:
    """log (tier, at seconds, seq) with granted: at most ``budget`` grants in any window, refusals free.

    Each grant depends on the grants before it, so a tier's requests are one sequence; rows are sorted
    by Spark and streamed, and a worker holds ``budget`` times at most.
    """
    dealt = log.repartition("tier").sortWithinPartitions("tier", "at", "seq")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema) + ", granted boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, deque()
        for frame in frames:
            out = []
            for tier, at in zip(frame["tier"], frame["at"], strict=True):
                if tier != now:
                    now, used = tier, deque()
                while used and at - used[0] >= window:
                    used.popleft()
                out.append(len(used) < budget)
                if out[-1]:
                    used.append(at)
            yield frame.assign(granted=out)

    return dealt.mapInPandas(run, kind)
