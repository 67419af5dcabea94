"""Row filters. Bounds are literals computed from ``as_of``, so they reach the scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload import dims
from caseload.functions import times, values

SOURCE_ZONE = {"tickets": times.EASTERN, "chats": times.ATLANTIC}


def ntz(moment: dt.datetime | None) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


# Partition column of the stored tables -> the timestamp whose month it holds.
MONTH_COLUMNS = {"create_ts_utc": "create_month", "created_ts_utc": "created_month"}


def between(df: DataFrame, ts: str, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """Inclusive on both ends; a missing bound is open.

    On a table stored by month the bounds also select the month folders.
    """
    month = MONTH_COLUMNS.get(ts)
    stored = month in df.columns
    first_day = lambda m: F.lit(m.date().replace(day=1))
    if start is not None:
        df = df.where(F.col(ts) >= ntz(start))
        df = df.where(F.col(month) >= first_day(start)) if stored else df
    if end is not None:
        df = df.where(F.col(ts) <= ntz(end))
        df = df.where(F.col(month) <= first_day(end)) if stored else df
    return df


def filter_range(df: DataFrame, start, end, ts: str = "create_ts_utc") -> DataFrame:
    """rows whose UTC time lies in [start, end]; tickets need both bounds, else all rows stay."""
    if ts == "create_ts_utc" and (start is None or end is None):
        return df
    return between(df, ts, start, end)


def range_counts(df: DataFrame, start, end, ts: str = "create_ts_utc") -> DataFrame:
    """rows before and after the range filter, in one pass."""
    inside = F.lit(True)
    if ts == "create_ts_utc" and (start is None or end is None):
        start = end = None
    if start is not None:
        inside = inside & (F.col(ts) >= ntz(start))
    if end is not None:
        inside = inside & (F.col(ts) <= ntz(end))
    return df.agg(F.count("*").alias("rows_before"), F.count_if(inside).alias("rows_after"))


def drop_spam(df: DataFrame) -> DataFrame:
    """rows without a pipeline stay."""
    return df.where(~F.col("pipeline").eqNullSafe(dims.SPAM_PIPELINE))


def support_team(df: DataFrame, team: list[str] = dims.SUPPORT_TEAM) -> DataFrame:
    """F3."""
    return df.where(F.col("case_owner").isin(team))


def named_range(name: str, source: str, as_of: dt.datetime) -> tuple[dt.datetime | None, dt.datetime | None]:
    """UTC bounds of ``all``, ``ytd``, ``13w`` (four quarters), ``Nd`` (business days), ``Nw``.

    ``as_of`` is naive UTC. Day and week ranges start at midnight under the UTC offset in force at
    ``as_of``, also when the start lies on the other side of a clock change.
    """
    if not name or name == "all":
        return None, None
    zone = ZoneInfo(SOURCE_ZONE[source])
    now = as_of.replace(tzinfo=dt.timezone.utc).astimezone(zone)
    wall, offset = now.replace(tzinfo=None), now.utcoffset()

    def from_local(moment):
        return moment.replace(tzinfo=zone).astimezone(dt.timezone.utc).replace(tzinfo=None)

    if name == "ytd":
        return from_local(dt.datetime(wall.year, 1, 1)), as_of
    if name == "13w":
        first = (wall.month - 1) // 3 * 3 + 1
        months = wall.year * 12 + first - 1 - 9
        return from_local(dt.datetime(months // 12, months % 12 + 1, 1)), as_of
    count = int(name[:-1])
    if name.endswith("d"):
        day = wall - dt.timedelta(days=1)
        left = count
        while True:
            left -= day.weekday() < 5
            if left <= 0:
                break
            day -= dt.timedelta(days=1)
    elif name.endswith("w"):
        day = wall - dt.timedelta(weeks=count)
    else:
        raise ValueError(f"unknown range {name!r}")
    return day.replace(hour=0, minute=0, second=0, microsecond=0) - offset, as_of


def local_days(bounds: tuple[dt.datetime, dt.datetime], source: str) -> tuple[dt.date, dt.date]:
    """The days in the source's zone on which UTC bounds fall."""
    zone = ZoneInfo(SOURCE_ZONE[source])
    day = lambda m: m.replace(tzinfo=dt.timezone.utc).astimezone(zone).date()
    return day(bounds[0]), day(bounds[1])


def filter_named_range(df: DataFrame, name: str, source: str, as_of: dt.datetime,
                       ts: str | None = None) -> DataFrame:
    ts = ts or ("create_ts_utc" if source == "tickets" else "created_ts_utc")
    return between(df, ts, *named_range(name, source, as_of))


def period_filter(df: DataFrame, period: str, start: dt.date | None = None,
                  end: dt.date | None = None, ts: str = "create_ts_local") -> DataFrame:
    """the last 4, 8 or 12 weeks before the newest row, or custom whole days [start, end]."""
    if period == "custom":
        if start:
            df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
        if end:
            df = df.where(F.col(ts) < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz"))
        return df
    weeks = {"4_weeks": 4, "8_weeks": 8, "12_weeks": 12}.get(period)
    if weeks is None:
        return df
    newest = df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest - F.make_dt_interval(days=F.lit(weeks * 7)))


def period_filter_now(df: DataFrame, period: str, as_of: dt.datetime,
                      ts: str = "create_ts_utc") -> DataFrame:
    """the last 4, 8 or 12 weeks before ``as_of``."""
    weeks = {"4_weeks": 4, "8_weeks": 8, "12_weeks": 12}.get(period)
    return df if weeks is None else df.where(F.col(ts) >= ntz(as_of - dt.timedelta(weeks=weeks)))


def calendar_bounds(kind: str, start: dt.date | None = None, end: dt.date | None = None):
    """UTC bounds of Eastern midnight to 23:59:59 for a week, a day or a span of days."""
    zone = ZoneInfo(times.EASTERN)
    utc = lambda m: m.replace(tzinfo=zone).astimezone(dt.timezone.utc).replace(tzinfo=None)
    if kind == "all":
        return None, None
    first = dt.datetime.combine(start, dt.time())
    if kind == "week":
        if start.weekday() != 0:
            raise ValueError(f"{start} is not a Monday")
        low = utc(first)
        return low, low + dt.timedelta(days=7, seconds=-1)
    if kind == "day":
        end = start
    elif kind != "custom":
        raise ValueError(f"unknown calendar filter {kind!r}")
    if end < start:
        raise ValueError("end date must not be before start date")
    return utc(first), utc(dt.datetime.combine(end, dt.time(23, 59, 59)))


def filter_calendar(df: DataFrame, kind: str, start=None, end=None, ts: str = "create_ts_utc") -> DataFrame:
    return between(df, ts, *calendar_bounds(kind, start, end))


def relative_bounds(period: str, as_of: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """F8: ``last N days``, ``this month``, ``last month``, ``this quarter``, ``this year``."""
    words = period.lower().split()
    if period == "this month":
        return as_of.replace(day=1), as_of
    if period == "last month":
        end = as_of.replace(day=1) - dt.timedelta(days=1)
        return end.replace(day=1), end
    if period == "this quarter":
        return as_of.replace(month=(as_of.month - 1) // 3 * 3 + 1, day=1), as_of
    if period == "this year":
        return as_of.replace(month=1, day=1), as_of
    if len(words) == 3 and words[0] in ("last", "past") and words[2].startswith("day"):
        return as_of - dt.timedelta(days=int(words[1])), as_of
    raise ValueError(f"unknown period {period!r}")


def filter_relative(df: DataFrame, period: str, as_of: dt.date, ts: str = "create_ts_utc") -> DataFrame:
    """F8: the end bound is the start of its day, as a date literal compares with a timestamp."""
    start, end = relative_bounds(period, as_of)
    midnight = lambda d: dt.datetime.combine(d, dt.time())
    return between(df, ts, midnight(start), midnight(end))


WINDOW_COLUMNS = ["create_ts_utc", "created_ts_utc"]


def rolling_window(df: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    """the last ``days`` days on the first timestamp column present."""
    ts = next((c for c in WINDOW_COLUMNS if c in df.columns), None)
    return df if ts is None else df.where(F.col(ts) >= ntz(as_of - dt.timedelta(days=days)))


def in_list(df: DataFrame, col: str, wanted: list[str] | None, negate: bool = False) -> DataFrame:
    """an empty list filters nothing; an exclusion keeps rows without a value."""
    if not wanted:
        return df
    hit = F.coalesce(F.col(col).isin(wanted), F.lit(False))
    return df.where(~hit if negate else hit)


def valid_hours(df: DataFrame, col: str = "first_response_hours") -> DataFrame:
    """numeric and greater than zero."""
    return df.withColumn(col, F.col(col).try_cast("double")).where(
        F.nanvl(F.col(col), F.lit(0.0)) > 0)


def view(df: DataFrame, which: str | None = None, exclude_live_chat: bool = False) -> DataFrame:
    """weekday or weekend rows, optionally without live chat."""
    if which not in (None, "weekday", "weekend"):
        raise ValueError(f"unknown view {which!r}")
    if which:
        df = df.where(F.col("is_weekend") == F.lit(which == "weekend"))
    return df.where(~values.is_live_chat(F.col("pipeline"))) if exclude_live_chat else df


def bucketed(df: DataFrame, ts: str, grain: str, name: str = "bucket") -> DataFrame:
    """F13."""
    return df.withColumn(name, times.bucket(F.col(ts), grain))


def search(df: DataFrame, query: str, limit: int = 10, key: str = "ticket_id") -> DataFrame:
    """case-insensitive substring in any text column, the first rows by key."""
    text = [f.name for f in df.schema.fields if f.dataType == T.StringType()]
    needle = query.lower()
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False)) for c in text]
    return df.where(reduce(lambda a, b: a | b, hits, F.lit(False))).orderBy(key).limit(limit)
