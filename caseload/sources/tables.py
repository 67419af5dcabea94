"""Reads from the stored tables, profiles and the export projection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.functions import values
from caseload.operators import chats, filters, tickets

CELL_LIMIT = 49_000


def store_by_month(df: DataFrame, path: str, ts: str, mode: str = "errorifexists") -> None:
    """Write a normalised table as Parquet in month folders, so that ranges prune folders.

    The rebalance hint gives every month files of about the advisory size: large months are split
    over several tasks, small ones share one.
    """
    month = filters.MONTH_COLUMNS[ts]
    keyed = df.withColumn(month, F.trunc(F.to_date(ts), "month"))
    keyed.hint("rebalance", month).write.mode(mode).partitionBy(month).parquet(path)


def get_tickets(df: DataFrame, start=None, end=None, pipeline: str | None = None,
                owner: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; ties by id."""
    out = filters.between(df, "create_ts_utc", start, end)
    if pipeline:
        out = out.where(F.col("pipeline") == pipeline)
    if owner:
        out = out.where(F.col("case_owner") == owner)
    out = out.orderBy(F.desc("create_ts_utc"), "ticket_id")
    return out.limit(limit) if limit else out


def get_chats(df: DataFrame, start=None, end=None, agent_type: str | None = None,
              agent_name: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; ties by id."""
    out = filters.between(df, "created_ts_utc", start, end)
    if agent_type:
        out = out.where(F.col("agent_type") == agent_type)
    if agent_name:
        out = out.where(F.col("display_agent") == agent_name)
    out = out.orderBy(F.desc("created_ts_utc"), "chat_id")
    return out.limit(limit) if limit else out


def dataset_info(df: DataFrame, ts: str) -> DataFrame:
    """S9."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.lit(", ".join(df.columns)).alias("columns"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def export_strings(df: DataFrame, data_type: str, as_of: dt.datetime, days: int = 365,
                   columns: list[str] | None = None) -> DataFrame:
    """Text cells of the rolling window; missing is empty, over-long cells are cut."""
    window = filters.rolling_window(df, days, as_of)
    window = window.select(*columns) if columns else window
    out = []
    for field in window.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.dataType.typeName().startswith("timestamp"):
            text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        elif field.dataType.typeName() in ("array", "map", "struct"):
            text = F.to_json(col)
        else:
            text = col.cast("string")
        clean = F.when(~text.isin("NaT", "nan", "NaN", "None", "<NA>"), text)
        out.append(values.truncate_text(F.coalesce(clean, F.lit("")), CELL_LIMIT).alias(field.name))
    stamp = F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return window.select(*out, stamp.alias("Last_Updated"), F.lit(data_type).alias("Data_Type"))


def export_tickets(df: DataFrame, as_of: dt.datetime, days: int = 365) -> DataFrame:
    """S13 for tickets: calendar labels, response bins, business hours, age and empty review columns
    are added before everything becomes text."""
    rows = filters.rolling_window(df, days, as_of)
    rows = tickets.calendar_fields(rows, "create_ts_local")
    rows = tickets.ticket_age(tickets.business_hours(tickets.response_bins(rows)), as_of)
    return export_strings(tickets.add_qa_fields(rows), "tickets", as_of, days)


def export_chats(df: DataFrame, as_of: dt.datetime, days: int = 365) -> DataFrame:
    """S13 for chats: calendar labels, time of day and rounded durations are added."""
    rows = filters.rolling_window(df, days, as_of)
    rows = chats.time_period(tickets.calendar_fields(rows, "created_ts_local"))
    seconds = F.col("duration_seconds")
    rows = rows.withColumns({
        "duration_minutes": values.rounded(seconds / 60, 2), "duration_hours": values.rounded(seconds / 3600, 2)})
    return export_strings(tickets.add_qa_fields(rows), "chats", as_of, days)


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a table available to ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df


def profile(df: DataFrame) -> DataFrame:
    """One row per column with its type, row count, values present and one sample value."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.min(F.col(f"`{c}`").cast("string")).alias(f"s{i}") for i, c in enumerate(df.columns)],
    )
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.lit(kinds[c]).alias("type"), F.col(f"n{i}").alias("present"),
                 F.col(f"s{i}").alias("sample"))
        for i, c in enumerate(df.columns)])
    return one.select("rows", F.explode(cols).alias("c")).select("c.*", "rows")
