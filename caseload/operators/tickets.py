"""Ticket normalisation: zones, names, pipelines, weekend and shift flags, first response."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload import dims, schema
from caseload.functions import times, values

TICKET_TIMES = [c[: -len("_ts")] for c in schema.TICKET_COLUMNS if c.endswith("_ts")]


def _as_utc(df: DataFrame, name: str):
    col = F.col(name)
    return times.parse_utc(col) if df.schema[name].dataType == T.StringType() else col


def ticket_tz(df: DataFrame) -> DataFrame:
    """Parse every ``*_ts`` or ``*_ts_utc`` column as UTC and add its Eastern view."""
    add = {}
    for base in TICKET_TIMES:
        source = next((c for c in (f"{base}_ts_utc", f"{base}_ts") if c in df.columns), None)
        if source:
            add[f"{base}_ts_utc"] = _as_utc(df, source)
    out = df.withColumns(add).drop(*[f"{b}_ts" for b in TICKET_TIMES])
    return out.withColumns({
        f"{base}_ts_local": times.to_zone(F.col(f"{base}_ts_utc"), times.EASTERN)
        for base in TICKET_TIMES if f"{base}_ts_utc" in out.columns
    })


def central_to_eastern(df: DataFrame, cols: list[str]) -> DataFrame:
    """Naive Central wall clock to Eastern.

    The repeated hour in autumn is read as standard time, a time in the spring gap moves to the
    end of the gap.
    """
    add = {}
    for name in cols:
        wall = _as_utc(df, name)
        back = lambda utc: times.to_zone(utc, times.CENTRAL)
        utc = times.from_zone(wall, times.CENTRAL)
        hour = F.make_dt_interval(hours=F.lit(1))
        gap_end = F.to_date(wall).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(wall) + 1)
        # In the gap the round trip does not return the same wall clock.
        shifted = times.from_zone(gap_end, times.CENTRAL)
        standard = F.when(back(utc + hour) == wall, utc + hour).otherwise(utc)
        fixed = F.when(back(utc) != wall, shifted).otherwise(standard)
        add[name] = times.to_zone(fixed, times.EASTERN)
    return df.withColumns(add)


def canonical_utc(df: DataFrame, src: str, base: str) -> DataFrame:
    """``<base>_utc`` and its ISO text ``<base>_iso``."""
    out = df.withColumn(f"{base}_utc", _as_utc(df, src))
    return out.withColumn(f"{base}_iso", times.iso_utc(F.col(f"{base}_utc")))


def map_staff(df: DataFrame, owner: str = "ticket_owner") -> DataFrame:
    """``case_owner`` is the real name behind an alias, other names pass through."""
    return df.withColumn("case_owner", values.staff_name(F.col(owner)))


def normalize_cs_agents(df: DataFrame, owner: str = "case_owner") -> DataFrame:
    """Canonical team names; rows of anybody else are dropped."""
    team = df.where(values.is_team_member(F.col(owner)))
    return team.withColumn(owner, values.team_member(F.col(owner)))


def map_pipelines(df: DataFrame, src: str = "pipeline_raw") -> DataFrame:
    """Pipeline id to label, other text passes through."""
    return df.withColumn("pipeline", values.pipeline_label(F.col(src)))


def display_pipeline(df: DataFrame) -> DataFrame:
    """Short display labels without the spam pipeline.

    The filter comes first, on the name itself: no other name is shown as spam, and a filter on the
    label would repeat the lookup for every row.
    """
    kept = df.where(~F.trim("pipeline").eqNullSafe(dims.SPAM_DISPLAY))
    return kept.withColumn("pipeline", values.pipeline_display(F.col("pipeline")))


def weekend_flag(df: DataFrame) -> DataFrame:
    """Friday 18:00 to Monday 05:00 Eastern."""
    return df.withColumn("is_weekend", times.desk_weekend(F.col("create_ts_local")))


def weekend_simple(df: DataFrame) -> DataFrame:
    """Saturday and Sunday only."""
    return df.withColumn("is_weekend", times.calendar_weekend(F.col("create_ts_local")))


def schedule_frame(spark: SparkSession, schedule: dict, fallback: dict) -> DataFrame:
    """The shift plan as one row per (agent, weekday); agent NULL holds the fallback plan."""
    order = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    minutes = lambda text: int(text[:2]) * 60 + int(text[3:5])
    rows = []
    for agent, week in [*schedule.items(), (None, fallback)]:
        for day in (week or {}):
            plan = week[day]
            full = plan == "full"
            shifts = [] if full else [(minutes(a), minutes(b)) for a, b in plan or []]
            rows.append((agent, order.index(day), full, shifts))
    shape = "agent string, dow int, full boolean, shifts array<struct<start:int,stop:int>>"
    return spark.createDataFrame(rows, shape)


def off_shift(
    df: DataFrame, schedule: dict | DataFrame | None = None, fallback: dict | None = None,
    buffer_minutes: int = dims.SHIFT_BUFFER_MINUTES,
) -> DataFrame:
    """``off_shift`` is true in the weekend window or outside every shift of the owner's day.

    A shift counts from ``buffer_minutes`` before its start; a stop before the start wraps over
    midnight; agents without a plan use the fallback plan; a day without an entry is off. A schedule may be
    a table as ``schedule_frame`` makes it, of any size and without an agent NULL: its weeks, one row per agent, are
    joined by agent, and Spark sizes the join.
    """
    spark = df.sparkSession
    schedule = dims.SHIFT_SCHEDULE if schedule is None else schedule
    fallback = dims.FALLBACK_SHIFTS if fallback is None else fallback
    plan = schedule if isinstance(schedule, DataFrame) else schedule_frame(spark, schedule, {}).where("agent IS NOT NULL")
    week = F.map_from_entries(F.collect_list(F.struct("dow", F.struct("full", "shifts"))))
    weeks = plan.groupBy(F.col("agent").alias("_agent")).agg(week.alias("_week"))
    others = schedule_frame(spark, {}, fallback).agg(week).scalar()  # seven days
    joined = df.join(weeks, F.trim("case_owner") == F.col("_agent"), "left")
    joined = joined.withColumn("_day", F.try_element_at(
        F.when(F.col("_agent").isNotNull(), F.col("_week")).otherwise(others), F.weekday("create_ts_local")))
    local = F.col("create_ts_local")
    now = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)

    def covers(shift):
        start = ((shift["start"] - buffer_minutes + 1440) % 1440) * 60
        stop = shift["stop"] * 60
        wraps = shift["stop"] < shift["start"]
        return F.when(wraps, (now >= start) | (now < stop)).otherwise((now >= start) & (now < stop))

    on = F.coalesce(F.col("_day.full") | F.exists("_day.shifts", covers), F.lit(False))
    flag = (F.when(local.isNull(), F.lit(False))
            .when(times.desk_weekend(local), F.lit(True)).otherwise(~on))
    return joined.withColumn("off_shift", flag).drop("_agent", "_week", "_day")


def first_response(df: DataFrame, strict_space: bool = False) -> DataFrame:
    """Hours to the first response. Live chat is 30 seconds; zero, negative or missing is NULL."""
    hours = times.hours_between(F.col("create_ts_utc"), F.col("first_response_ts_utc"))
    live = values.is_live_chat(F.col("pipeline"), strict_space)
    return df.withColumn(
        "first_response_hours",
        F.when(live, F.lit(dims.LIVE_CHAT_RESPONSE_SECONDS / 3600)).when(hours > 0, hours))


def hms_to_hours(df: DataFrame, col: str = "reply_hms", name: str = "reply_hours") -> DataFrame:
    """N16."""
    return df.withColumn(name, values.hms_hours(F.col(col)))


def calendar_fields(df: DataFrame, ts: str) -> DataFrame:
    """Day, weekend, quarter and month labels."""
    t = F.col(ts)
    quarter = F.concat(F.lit("Q"), F.quarter(t))
    return df.withColumns({
        "day_number": F.weekday(t) + 1,
        "day_name": F.date_format(t, "EEEE"),
        "is_weekend_day": F.weekday(t) >= 5,
        "is_weekday": F.weekday(t) < 5,
        "fy_quarter": F.quarter(t),
        "fy_quarter_name": quarter,
        "fy_year": F.year(t),
        "fy_quarter_full": F.concat(F.year(t), F.lit("-"), quarter),
        "month_number": F.month(t),
        "month_name": F.date_format(t, "MMMM"),
        "month_year": F.date_format(t, "yyyy-MM (MMMM)"),
    })


def response_bins(df: DataFrame) -> DataFrame:
    """Category plus hours and days to two decimals."""
    hours = F.col("first_response_hours")
    return df.withColumns({
        "response_hours_clean": values.rounded(hours, 2),
        "response_days": values.rounded(hours / 24, 2),
        "response_category": values.response_bin(hours),
    })


def business_hours(df: DataFrame) -> DataFrame:
    """N28."""
    return df.withColumn("in_business_hours", times.business_hours(F.col("create_ts_local")))


def ticket_age(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Days since creation, one decimal."""
    days = times.hours_between(F.col("create_ts_utc"), F.lit(as_of).cast("timestamp_ntz")) / 24
    return df.withColumn("ticket_age_days", values.rounded(days, 1))


def normalize_tickets(df: DataFrame) -> DataFrame:
    """N3, N8, N10, N12, N15 in this order."""
    return first_response(weekend_flag(map_pipelines(map_staff(ticket_tz(df)))))


def add_qa_fields(df: DataFrame) -> DataFrame:
    """Empty quality-review columns, filled later by ``integrate_qa``."""
    return df.withColumns({c: F.lit("") for c in dims.QA_FIELDS if c not in df.columns})
