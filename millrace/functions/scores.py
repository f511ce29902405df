"""Numbers: dates, decay, backoff, vectors, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def age_days(published: Column, as_of: Column) -> Column:
    """Whole days since an RFC 2822 or ISO 8601 date, 0 for the future, null when it does not say."""
    raw = F.trim(F.coalesce(published, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    mail = F.coalesce(*[F.try_to_timestamp(plain, F.lit(x)) for x in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")])
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(raw))
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(F.coalesce(mail, iso))
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("double") + F.lit(0.0) * seconds


def freshness(age: Column, weight: float, half_life: float = 21.0) -> Column:
    """Factor of recency: bounded, and 1 without a date."""
    return F.lit(1.0 - weight) + F.lit(weight) * F.coalesce(F.pow(F.lit(0.5), age / F.lit(half_life)), F.lit(1.0))


def decay(ts: Column, as_of: Column, half_life_days: float = 14.0) -> Column:
    """What one outcome still counts: half after each half-life; the future counts in full."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86400e6))
    return F.pow(F.lit(0.5), days / F.lit(half_life_days))


def laplace(ok: Column, fail: Column) -> Column:
    return (ok + 1.0) / (ok + fail + 2.0)


def backoff(strikes: Column, base: float = 300.0, most: float = 3600.0) -> Column:
    """Seconds of rest after so many refusals in a row."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(strikes - 1, F.lit(20))), F.lit(most))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; cosine where both are of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def passage_id(url: Column, model: Column, i: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", url, model, i.cast("string")), 256), 1, 24)


def cache_key(kind: Column, *parts: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))
