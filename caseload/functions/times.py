"""Column expressions for zones, week conventions, weekend rules and calendar labels.

Timestamps are ``timestamp_ntz``: ``*_utc`` columns hold UTC, ``*_local`` columns a wall clock. The
session zone must be UTC (``build_session`` sets it, ``require_utc`` enforces it); the casts between the
two timestamp types are then free of clock changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = "UTC"
EASTERN = "America/New_York"
CENTRAL = "America/Chicago"
ATLANTIC = "America/Halifax"

# Fixed values. Text formats accepted besides ISO-8601.
EXPORT_FORMATS = ["MM/dd/yyyy HH:mm", "MM/dd/yyyy hh:mm a", "MM/dd/yyyy"]

GRAINS = ("day", "week_mon", "week_tue", "month", "quarter")


def _dated(col: Column) -> Column:
    """Text that begins with year and month; a cast would turn a bare clock into a time of the present day."""
    return F.when(col.rlike(r"^\s*[0-9]{4}-[0-9]"), col).try_cast("timestamp")


def parse_utc(col: Column) -> Column:
    """Text to UTC wall clock; an offset in the text is honoured, bad text, a bare clock or year is NULL."""
    text = col.cast("string")
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in EXPORT_FORMATS]
    return F.coalesce(_dated(text), *parsed).cast("timestamp_ntz")


def parse_iso(col: Column) -> Column:
    """ISO-8601 text to UTC wall clock; bad text, a bare clock or year is NULL."""
    return _dated(col.cast("string")).cast("timestamp_ntz")


def to_zone(ts_utc: Column, zone: str) -> Column:
    """Wall clock of a zone. ``from_utc_timestamp`` resolves a literal zone once per task, while
    ``convert_timezone`` parses both zone names for every row."""
    return F.from_utc_timestamp(ts_utc.cast("timestamp"), zone).cast("timestamp_ntz")


def from_zone(wall: Column, zone: str) -> Column:
    """UTC of a zone's wall clock; a repeated hour counts as its first occurrence."""
    return F.to_utc_timestamp(wall.cast("timestamp"), zone).cast("timestamp_ntz")


def iso_utc(ts_utc: Column) -> Column:
    return F.date_format(ts_utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bucket(ts: Column, grain: str) -> Column:
    """Start date of the bucket. ``week_tue`` weeks run Tuesday to Monday."""
    day = F.to_date(ts)
    if grain == "day":
        return day
    if grain == "week_mon":
        return F.trunc(day, "week")
    if grain == "week_tue":
        return F.date_add(F.trunc(F.date_sub(day, 1), "week"), 1)
    if grain in ("month", "quarter"):
        return F.trunc(day, grain)
    raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")


def quarter_label(day: Column) -> Column:
    """``Q3 2025``."""
    return F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))


def desk_weekend(local: Column) -> Column:
    """Friday from 18:00 to Monday before 05:00; a missing time is not a weekend."""
    # Hours since Monday 05:00; the weekend starts 109 hours later.
    hours = F.pmod(F.weekday(local) * 24 + F.hour(local) - 5, F.lit(168))
    return F.coalesce(hours >= 109, F.lit(False))


def calendar_weekend(local: Column) -> Column:
    """Saturday or Sunday; a missing time is not a weekend."""
    return F.coalesce(F.weekday(local) >= 5, F.lit(False))


def business_hours(local: Column) -> Column:
    """Monday to Friday, 09:00 up to 17:00; a missing time is outside."""
    inside = (F.weekday(local) < 5) & (F.hour(local) >= 9) & (F.hour(local) < 17)
    return F.coalesce(inside, F.lit(False))


def micros_between(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return micros(end) - micros(start)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(3600000000.0)


def days_between(start: Column, end: Column) -> Column:
    """Whole elapsed days, as a timedelta counts them."""
    return F.floor(micros_between(start, end) / F.lit(86400000000))
