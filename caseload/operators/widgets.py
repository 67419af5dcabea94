"""Parameterised reports: range, filters, grain and aggregate in one call.

Ticket reports take normalised tickets of the support team without spam, or the cells of a stored rollup of
them (``rollup``), chat reports normalised chats. Arguments are checked against the values each report accepts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload import dims
from caseload.functions import times, values
from caseload.operators import filters
from caseload.operators.distribution import counted_rows, mean_of, summarize, weight_of
from caseload.operators.chats import one_copy
from caseload.operators.joins import explode_agents
from caseload.operators.ticket_reports import HOURS, _check_stat
from caseload.operators.tickets import display_pipeline, normalize_cs_agents
from caseload.operators.trends import last_rows, with_trend

DEFAULT_RANGE = "12w"
MOST_COLUMNS = 1_000


@dataclass(frozen=True)
class Report:
    """A report with the range values it accepts."""

    fn: Callable[..., DataFrame]
    ranges: tuple[str, ...]


REPORTS: dict[str, Report] = {}


def report(*ranges: str):
    """Register a report under its function name and check its ``range_`` argument."""

    def wrap(fn):
        def checked(*args, range_: str = DEFAULT_RANGE, **params):
            if range_ not in ranges:
                raise ValueError(f"{fn.__name__}: range {range_!r} is not one of {ranges}")
            return fn(*args, range_=range_, **params)

        checked.__name__, checked.__doc__ = fn.__name__, fn.__doc__
        REPORTS[fn.__name__] = Report(checked, ranges)
        return checked

    return wrap


WIDE = ("7d", "8w", "12w", "13w", "ytd", "all")
CHAT_WIDE = ("8w", "12w", "13w", "ytd", "all")


def _tickets(df: DataFrame, range_: str, as_of: dt.datetime) -> DataFrame:
    return display_pipeline(filters.filter_named_range(df, range_, "tickets", as_of))


def _team(df: DataFrame, agents: list[str] | None) -> DataFrame:
    return filters.in_list(normalize_cs_agents(df), "case_owner", agents)


def _chats(df: DataFrame, range_: str, as_of: dt.datetime, *cols: str) -> DataFrame:
    """One row per chat in the range, with the columns ``cols`` that a report reads.

    All reports see the same copy of a chat (``one_copy``), chosen before the range is applied. A table that
    already has one row per chat, stored with the column ``first_copy``, is not looked through again.
    """
    unique = df if "first_copy" in df.columns else one_copy(df)
    return filters.filter_named_range(unique, range_, "chats", as_of).select("chat_id", "created_ts_utc", *cols)


def _rating_days(ratings: DataFrame, range_: str, as_of: dt.datetime) -> DataFrame:
    """The days of the range; ``all`` means every day."""
    start, end = filters.named_range(range_, "chats", as_of)
    if start is None:
        return ratings
    first, last = filters.local_days((start, end or as_of), "chats")
    return ratings.where(F.col("date").between(F.lit(first), F.lit(last)))


def _medians(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians of the response time per group."""
    weight = weight_of(df)
    return summarize(df.select(*keys, HOURS, *([weight] if weight else [])), keys, HOURS, weight=weight)


def _period(df: DataFrame, ts: str, range_: str, week: str = "week_tue") -> tuple[DataFrame, bool]:
    """Add ``period`` (a date) by the grain rule; the flag tells whether it is quarterly.

    ``7d`` is daily without Saturday and Sunday, ``13w`` quarterly, everything else weekly.
    """
    known = df.where(F.col(ts).isNotNull())
    if range_ == "13w":
        return known.withColumn("period", times.bucket(F.col(ts), "quarter")), True
    if range_ == "7d":
        return known.where(F.weekday(ts) < 5).withColumn("period", F.to_date(ts)), False
    return known.withColumn("period", times.bucket(F.col(ts), week)), False


def _labelled(df: DataFrame, quarterly: bool) -> DataFrame:
    """The last four quarters with a ``Qn yyyy`` label; other grains keep all rows and the date."""
    label = times.quarter_label(F.col("period")) if quarterly else F.date_format("period", "yyyy-MM-dd")
    return (last_rows(df, ["period"], 4) if quarterly else df).withColumn("label", label)


@report(*WIDE)
def volume_daily_historic(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                          source: str = "tickets", include_weekends: bool = True) -> DataFrame:
    """Rows per day of tickets or chats, optionally without Saturday and Sunday."""
    if source == "tickets":
        rows, ts = _tickets(df, range_, as_of), "create_ts_local"
    elif source == "chats":
        rows, ts = _chats(df, range_, as_of, "created_ts_local"), "created_ts_local"
    else:
        raise ValueError(f"unknown source {source!r}")
    rows = rows.where(F.col(ts).isNotNull())
    if not include_weekends:
        rows = rows.where(F.weekday(ts) < 5)
    return rows.groupBy(F.to_date(ts).alias("day")).agg(counted_rows(rows).alias("rows"))


@report("all", "52w", "26w", "12w", "8w", "4w")
def tickets_by_pipeline(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                        pipelines: list[str] | None = None) -> DataFrame:
    """W2."""
    rows = filters.in_list(_tickets(df, range_, as_of), "pipeline", pipelines)
    return rows.groupBy("pipeline").agg(counted_rows(rows).alias("tickets"))


@report(*WIDE)
def weekday_weekend_distribution(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE) -> DataFrame:
    """W3."""
    from caseload.operators.ticket_reports import weekend_distribution

    return weekend_distribution(_tickets(df, range_, as_of))


@report("7d", "all", "ytd", "13w", "12w", "8w")
def weekly_response_breakdown(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                              view: str = "weekday", stat: str = "median",
                              show_trend: bool = True) -> DataFrame:
    """Response time per day, week or quarter of the weekday or the weekend tickets."""
    _check_stat(stat)
    rows = filters.valid_hours(filters.view(_tickets(df, range_, as_of), view))
    rows, quarterly = _period(rows, "create_ts_local", range_)
    if stat == "mean":
        stats = rows.groupBy("period").agg(mean_of(rows, HOURS).alias("response_hours"))
    else:
        stats = _medians(rows, ["period"]).select(
            "period", F.col("median").alias("response_hours"))
    out = _labelled(stats, quarterly)
    return with_trend(out, "period", {"response_hours": "trend"}) if show_trend else out


@report(*WIDE)
def agent_ticket_volume_distribution(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                     agents: list[str] | None = None) -> DataFrame:
    """Weekday tickets per team member."""
    rows = _team(filters.view(_tickets(df, range_, as_of), "weekday"), agents)
    return _agent_counts(rows)


def _agent_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("case_owner").alias("agent")).agg(counted_rows(rows).alias("tickets"))


@report(*WIDE)
def agent_response_time_comparison(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                   agents: list[str] | None = None,
                                   exclude_pipelines: list[str] | None = None) -> DataFrame:
    """Median response per team member without the excluded pipelines (live chat by default)."""
    dropped = [p.strip() for p in exclude_pipelines or [dims.LIVE_CHAT]]
    rows = _team(_tickets(df, range_, as_of), agents)
    rows = filters.valid_hours(filters.in_list(rows, "pipeline", dropped, negate=True))
    stats = _medians(rows, ["case_owner"])
    return stats.select(F.col("case_owner").alias("agent"), F.col("median").alias("median_hours"))


SERIES = ("total", "bot", "human", "trend")


@report(*CHAT_WIDE)
def chat_weekly_volume_breakdown(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                 series: tuple[str, ...] = SERIES) -> DataFrame:
    """Total, bot-only and transferred chats per week or quarter with the trend of the total."""
    unknown = set(series) - set(SERIES)
    if unknown:
        raise ValueError(f"unknown series {sorted(unknown)}")
    rows, quarterly = _period(_chats(df, range_, as_of, "created_ts_local", "bot_transfer"), "created_ts_local", range_)
    human = F.coalesce(F.col("bot_transfer"), F.lit(False))
    counts = rows.groupBy("period").agg(
        F.count("*").alias("total"), F.count_if(~human).alias("bot"), F.count_if(human).alias("human"))
    out = with_trend(_labelled(counts, quarterly), "period", {"total": "trend"})
    keep = [s for s in SERIES if s in series and (s != "trend" or "total" in series)]
    return out.select("period", "label", *keep)


@report("7d", "all", "52w", "26w", "13w", "12w", "8w", "4w")
def weekly_bot_satisfaction(ratings: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE) -> DataFrame:
    """Sum of good over sum of rated per day, week or quarter of the daily ratings.

    ``ratings`` is the output of ``explode_ratings``. ``all`` is every day, ``7d`` the last seven
    days that have ratings.
    """
    days = _rating_days(ratings, range_, as_of)
    if range_ == "7d":
        rows, quarterly = last_rows(days, ["date"], 7).withColumn("period", F.col("date")), False
    else:
        quarterly = range_ == "13w"
        rows = days.withColumn("period", times.bucket(F.col("date"), "quarter" if quarterly else "week_tue"))
    sums = rows.groupBy("period").agg(F.sum("good").alias("good"), F.sum("total").alias("total_ratings"))
    rate = values.percent(F.col("good"), F.col("total_ratings"))
    return _labelled(sums.withColumn("satisfaction_pct", rate), quarterly).drop("good")


@report(*CHAT_WIDE)
def bot_volume_duration(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                        bots: list[str] | None = None) -> DataFrame:
    """Chats and mean minutes per bot."""
    chats = _chats(df, range_, as_of, "agent_type", "display_agent", "duration_minutes")
    rows = filters.in_list(chats.where(F.col("agent_type") == "bot"), "display_agent", bots)
    return rows.groupBy(F.col("display_agent").alias("bot")).agg(
        F.count("*").alias("chats"), F.avg("duration_minutes").alias("mean_duration"))


@report(*CHAT_WIDE)
def human_volume_duration(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                          agents: list[str] | None = None) -> DataFrame:
    """Chats and mean minutes per team member named in ``human_agents``."""
    rows = filters.in_list(explode_agents(_chats(df, range_, as_of, "human_agents", "duration_minutes")), "human_agent", agents)
    return rows.groupBy(F.col("human_agent").alias("agent")).agg(
        F.count("duration_minutes").alias("chats"), F.avg("duration_minutes").alias("mean_duration"))


@report("all", "12w", "8w")
def agent_weekly_response_by_agent(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                   agents: list[str] | None = None) -> DataFrame:
    """Median response per week and owner."""
    rows = filters.valid_hours(filters.in_list(_tickets(df, range_, as_of), "case_owner", agents))
    rows, _ = _period(rows.where(F.col("case_owner").isNotNull()), "create_ts_local", range_)
    stats = _medians(rows, ["period", "case_owner"])
    return stats.select(
        F.col("period").alias("week"), F.col("case_owner").alias("agent"),
        F.col("median").alias("median_hours"))


@report("all", "12w", "8w", "13w")
def agent_weekly_ticket_volume_by_agent(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                        agents: list[str] | None = None) -> DataFrame:
    """Tickets per week (or per each of the last four quarters) and team member."""
    rows, quarterly = _period(_team(_tickets(df, range_, as_of), agents), "create_ts_local", range_)
    counts = rows.groupBy("period", F.col("case_owner").alias("agent")).agg(counted_rows(rows).alias("tickets"))
    if quarterly:
        recent = F.dense_rank().over(Window.orderBy(F.desc("period")))
        counts = counts.withColumn("_r", recent).where(F.col("_r") <= 4).drop("_r")
        return counts.withColumn("label", times.quarter_label(F.col("period")))
    return counts.withColumn("label", F.date_format("period", "yyyy-MM-dd"))


@report(*WIDE)
def performance_vs_volume(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                          agents: list[str] | None = None) -> DataFrame:
    """Tickets per team member."""
    return _agent_counts(_team(_tickets(df, range_, as_of), agents))


@report("7d", "4w", "12w", "ytd", "all")
def daily_chat_trends_performance(df: DataFrame, ratings: DataFrame, as_of: dt.datetime,
                                  range_: str = DEFAULT_RANGE) -> DataFrame:
    """W14 with J7: chats, transfers and transfer rate per day joined with that day's satisfaction."""
    rows = _chats(df, range_, as_of, "date", "bot_transfer")
    moved = F.count_if(F.col("bot_transfer"))
    daily = rows.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.count("*").alias("chats"), moved.alias("transfers"),
        values.percent(moved, F.count("*")).alias("transfer_rate"))
    return join_daily_satisfaction(daily, _rating_days(ratings, range_, as_of).select("date", "satisfaction_pct"))


def join_daily_satisfaction(daily: DataFrame, scores: DataFrame) -> DataFrame:
    """Left join on the day, 0 where a day has no rating."""
    return daily.join(scores, "date", "left").withColumn(
        "satisfaction_pct", F.coalesce("satisfaction_pct", F.lit(0.0)))


def found_labels(long: DataFrame, pipelines: list[str] | None) -> list[str]:
    """Pipeline columns of a pivot: the given list, or every label found.

    A table of more than ``MOST_COLUMNS`` labels is refused rather than cut; its long form has them all.
    """
    if pipelines:
        return pipelines
    labels = [r["pipeline"] for r in long.select("pipeline").distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(labels) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} pipelines; use the long form")
    return sorted(p for p in labels if p is not None)


@report(*WIDE)
def pipeline_distribution_by_agent(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                   agents: list[str] | None = None, pipelines: list[str] | None = None,
                                   wide: bool = False) -> DataFrame:
    """Tickets per team member and pipeline, largest agents first.

    ``wide`` pivots over the labels found (or ``pipelines``), which takes a job of its own.
    """
    rows = filters.in_list(_team(_tickets(df, range_, as_of), agents), "pipeline", pipelines)
    counts = rows.groupBy(F.col("case_owner").alias("agent"), "pipeline").agg(counted_rows(rows).alias("tickets"))
    if not wide:
        return counts
    cell = lambda p: F.sum(F.when(F.col("pipeline") == p, F.col("tickets")).otherwise(0)).alias(p)
    out = counts.groupBy("agent").agg(
        *[cell(p) for p in found_labels(counts, pipelines)], F.sum("tickets").alias("total"))
    return out.orderBy(F.desc("total"), "agent")


@report(*WIDE)
def pipeline_response_time_heatmap(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                                   agents: list[str] | None = None, pipelines: list[str] | None = None,
                                   wide: bool = False) -> DataFrame:
    """Median response per team member and pipeline."""
    rows = filters.in_list(_team(_tickets(df, range_, as_of), agents), "pipeline", pipelines)
    stats = _medians(filters.valid_hours(rows), ["case_owner", "pipeline"]).withColumnRenamed("case_owner", "agent")
    if not wide:
        return stats.select("agent", "pipeline", F.col("median").alias("median_hours"))
    cell = lambda p: F.max(F.when(F.col("pipeline") == p, F.col("median"))).alias(p)
    return stats.groupBy("agent").agg(*[cell(p) for p in found_labels(stats, pipelines)])


@report(*WIDE)
def historic_weekly_volume(df: DataFrame, as_of: dt.datetime, range_: str = DEFAULT_RANGE,
                           agents: list[str] | None = None, pipelines: list[str] | None = None) -> DataFrame:
    """Tickets per Monday week, per weekday for ``7d``, per quarter for ``13w``."""
    rows = filters.in_list(_tickets(df, range_, as_of), "case_owner", agents)
    rows = filters.in_list(rows, "pipeline", pipelines)
    rows, quarterly = _period(rows, "create_ts_local", range_, week="week_mon")
    counts = rows.groupBy("period").agg(counted_rows(rows).alias("tickets"))
    return _labelled(counts, quarterly)


def run_report(name: str, *tables: DataFrame, as_of: dt.datetime, **params) -> DataFrame:
    """Run a registered report by name."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}, expected one of {sorted(REPORTS)}")
    return REPORTS[name].fn(*tables, as_of, **params)
