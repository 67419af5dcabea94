"""Ticket reports from a stored rollup that a sync has added late and changed tickets to."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import rollup, ticket_reports
from caseload.operators import widgets as w
from caseload.plans import fixtures as fx
from caseload.plans import ticket_queries, widget_queries  # noqa: F401
from caseload.plans.catalog import same_rows
from caseload.session import scratch_path
from caseload.sources import tables


@lru_cache(maxsize=4)
def _stored(spark: SparkSession, sf: str) -> tuple[rollup.RollupTable, str]:
    """The rollup and the tickets by month; both are built once a session, as reports find them.

    One ticket in fifty arrives late, one has no response at first; the sync that brings them runs twice.
    """
    path = scratch_path(spark, "desk")
    tables.store_by_month(fx.desk(spark, sf), path, "create_ts_utc")
    desk = spark.read.parquet(path)
    open_then = F.col("ticket_id") % 50 == 1
    early = desk.where("ticket_id % 50 <> 0").withColumn(
        "first_response_hours", F.when(~open_then, F.col("first_response_hours")))
    table = rollup.RollupTable(spark, scratch_path(spark, "rollup"))
    table.build(early)
    delta = rollup.change(early.where(open_then), desk.where("ticket_id % 50 < 2"))
    for _ in range(2):
        table.add(delta, 1)
    return table, path


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf)[0].read()


def _until(spark: SparkSession, sf: str) -> DataFrame:
    table, path = _stored(spark, sf)
    return table.read_until(spark.read.parquet(path), fx.TICKETS_AS_OF)


@same_rows("w1_rollup", "w1_volume_daily_historic_tickets")
def _(spark, sf):
    return w.volume_daily_historic(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w2_rollup", "w2_tickets_by_pipeline")
def _(spark, sf):
    return w.tickets_by_pipeline(_until(spark, sf), fx.TICKETS_AS_OF, range_="52w")


@same_rows("w3_rollup", "w3_weekday_weekend_distribution")
def _(spark, sf):
    return w.weekday_weekend_distribution(_until(spark, sf), fx.TICKETS_AS_OF, range_="ytd")


@same_rows("w4_rollup", "w4_weekly_response_breakdown")
def _(spark, sf):
    return w.weekly_response_breakdown(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w4_rollup_weekend_mean", "w4_weekly_response_breakdown_weekend_mean")
def _(spark, sf):
    return w.weekly_response_breakdown(
        _until(spark, sf), fx.TICKETS_AS_OF, range_="12w", view="weekend", stat="mean")


@same_rows("w4_rollup_daily", "w4_weekly_response_breakdown_daily")
def _(spark, sf):
    return w.weekly_response_breakdown(_until(spark, sf), fx.TICKETS_AS_OF, range_="7d")


@same_rows("w5_rollup", "w5_agent_ticket_volume_distribution")
def _(spark, sf):
    return w.agent_ticket_volume_distribution(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w6_rollup", "w6_agent_response_time_comparison")
def _(spark, sf):
    return w.agent_response_time_comparison(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w11_rollup", "w11_agent_weekly_response_by_agent")
def _(spark, sf):
    return w.agent_weekly_response_by_agent(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w12_rollup_quarterly", "w12_agent_weekly_ticket_volume_by_agent_quarterly")
def _(spark, sf):
    return w.agent_weekly_ticket_volume_by_agent(_until(spark, sf), fx.TICKETS_AS_OF, range_="13w")


@same_rows("w13_rollup", "w13_performance_vs_volume")
def _(spark, sf):
    return w.performance_vs_volume(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w15_rollup", "w15_pipeline_distribution_by_agent_long")
def _(spark, sf):
    return w.pipeline_distribution_by_agent(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w16_rollup", "w16_pipeline_response_time_heatmap_long")
def _(spark, sf):
    return w.pipeline_response_time_heatmap(_all(spark, sf), fx.TICKETS_AS_OF, range_="all")


@same_rows("w17_rollup_daily", "w17_historic_weekly_volume_daily")
def _(spark, sf):
    return w.historic_weekly_volume(_until(spark, sf), fx.TICKETS_AS_OF, range_="7d")


@same_rows("a7_rollup", "a7_weekly_response_median")
def _(spark, sf):
    return ticket_reports.weekly_response(_all(spark, sf))


@same_rows("a7_rollup_mean", "a7_weekly_response_mean")
def _(spark, sf):
    return ticket_reports.weekly_response(_all(spark, sf), "mean")
