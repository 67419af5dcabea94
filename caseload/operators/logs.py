"""Application logs and processing runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import values
from caseload.operators.filters import ntz
from caseload.operators.sync import retain
from caseload.operators.trends import last_rows

LOG_DAYS = 7
DETAIL_LIMIT = 45_000


def recent_logs(df: DataFrame, as_of: dt.datetime, hours: int = 24, level: str | None = None,
                limit: int = 500) -> DataFrame:
    """L1: newest first; ties by id."""
    rows = df.where(F.col("ts_utc") >= ntz(as_of - dt.timedelta(hours=hours)))
    if level:
        rows = rows.where(F.col("level") == level)
    return rows.orderBy(F.desc("ts_utc"), F.desc("log_id")).limit(limit)


def log_stats(df: DataFrame) -> DataFrame:
    """L2: rows per level next to the total and the oldest and newest time."""
    counts = df.groupBy(F.coalesce("level", F.lit("UNKNOWN")).alias("level")).agg(
        F.count("*").alias("logs"), F.min("ts_utc").alias("lo"), F.max("ts_utc").alias("hi"))
    whole = Window.partitionBy()
    return counts.select(
        "level", "logs", F.sum("logs").over(whole).alias("total_logs"),
        F.min("lo").over(whole).alias("oldest_log"), F.max("hi").over(whole).alias("newest_log"))


def log_retain(df: DataFrame, as_of: dt.datetime, days: int = LOG_DAYS) -> DataFrame:
    """L3."""
    return retain(df, "ts_utc", days, as_of)


def last_entries(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` log rows of each run; Spark cuts every run to ``n`` rows before the shuffle."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("ts_utc"), F.desc("log_id"))
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)


def run_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """L4: per run its span, duration text, error and warning counts and the last messages."""
    is_level = lambda name: F.count_if(F.col("level") == name)
    span = F.timestamp_diff("MILLISECOND", F.min("ts_utc"), F.max("ts_utc"))
    runs = df.groupBy("run_id").agg(
        F.min("ts_utc").alias("start_time"), F.max("ts_utc").alias("end_time"), span.alias("duration_ms"),
        F.count("*").alias("entries"), is_level("ERROR").alias("error_count"),
        is_level("WARNING").alias("warning_count"))
    line = F.concat(F.lit("["), F.coalesce("stage", F.lit("UNKNOWN")), F.lit("] "),
                    F.coalesce("message", F.lit("")))
    # Rank n is the oldest of the kept rows, so descending rank is log order.
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("_rn", line.alias("t")))))
    tail = last_entries(df, n).groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["t"]), " | ").alias("details"))
    return runs.join(tail, "run_id", "left").select(
        "run_id", "start_time", "end_time", "duration_ms",
        values.readable_ms(F.col("duration_ms")).alias("duration_readable"), "entries", "error_count",
        "warning_count", values.truncate_text(F.col("details"), DETAIL_LIMIT).alias("details"))


def run_details(runs: DataFrame, n: int = 10) -> DataFrame:
    """L4 for run records that already carry their ``log_entries`` array."""
    entries = F.coalesce("log_entries", F.array().cast(runs.schema["log_entries"].dataType))
    has = lambda name: F.size(F.filter(entries, lambda e: e["level"] == name))
    tail = F.slice(entries, F.greatest(F.size(entries) - (n - 1), F.lit(1)), n)
    text = F.array_join(F.transform(tail, lambda e: F.concat(
        F.lit("["), F.coalesce(e["stage"], F.lit("UNKNOWN")), F.lit("] "),
        F.coalesce(e["message"], F.lit("")))), " | ")
    return runs.withColumns({
        "duration_readable": values.readable_ms(F.col("total_duration_ms")),
        "error_count": has("ERROR"), "warning_count": has("WARNING"),
        "details": values.truncate_text(text, DETAIL_LIMIT)})


def recent_runs(df: DataFrame, n: int = 20, entries: int = 20) -> DataFrame:
    """The newest runs with their last entries, one row per entry in log order."""
    runs = last_rows(
        df.groupBy("run_id").agg(F.max("ts_utc").alias("end_time"), F.min("ts_utc").alias("start_time")),
        ["end_time", "run_id"], n)
    rows = df.join(runs, "run_id")
    kept = last_entries(rows, entries)
    return kept.select("run_id", "start_time", "end_time", "log_id", "ts_utc", "level", "stage", "message")


def entries_since(df: DataFrame, since: dt.datetime) -> DataFrame:
    """Log rows after a time, oldest first."""
    return df.where(F.col("ts_utc") > ntz(since)).orderBy("ts_utc", "log_id")
