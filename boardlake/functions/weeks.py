"""ISO weeks that begin at a reset time: identity of a timestamp's week, and the range of a week key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_minutes(offset: Column) -> Column:
    """Minutes of a UTC offset like ``+03:00`` (14 hours at most); null if it is malformed."""
    ok = offset.rlike(r"^[+-](0[0-9]|1[0-4]):[0-5][0-9]$")
    size = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    return F.when(ok, F.when(offset.startswith("-"), -size).otherwise(size))


def shifted(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def week_identity(ts: Column, minutes: Column) -> Column:
    """struct(key, year, week, starts_at, ends_at) of the week that ``ts`` is in, ``minutes`` ahead of UTC."""
    local = shifted(ts, minutes)
    year, week = F.extract(F.lit("YEAROFWEEK"), local), F.weekofyear(local)
    start = shifted(F.date_trunc("week", local), -minutes)
    return F.struct(week_key(year, week).alias("key"), year.alias("year"), week.alias("week"), start.alias("starts_at"), shifted(start, F.lit(7 * 24 * 60)).alias("ends_at"))


def week_key(year: Column, week: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def week_range(key: Column, minutes: Column) -> Column:
    """struct(starts_at, ends_at) of a key like ``2026-W15``; null unless its week is 1 to 53."""
    year, week = F.regexp_extract(key, r"^(\d{4})-W(\d{2})$", 1), F.regexp_extract(key, r"^(\d{4})-W(\d{2})$", 2)
    first = F.date_trunc("week", F.make_date(year.try_cast("int"), F.lit(1), F.lit(4)))
    start = shifted(first, (week.try_cast("int") - 1) * 7 * 24 * 60 - minutes)
    return F.when(week.try_cast("int").between(1, 53), F.struct(start.alias("starts_at"), shifted(start, F.lit(7 * 24 * 60)).alias("ends_at")))
