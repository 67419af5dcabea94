"""Tickets and chats side by side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import values
from caseload.operators import filters
from caseload.operators.chat_reports import chat_overview
from caseload.operators.ticket_reports import ticket_summary


def cross_channel(tickets: DataFrame, chats: DataFrame) -> DataFrame:
    """Interactions, share of each channel and the agents of both channels."""
    weekday = ~F.col("is_weekend")
    t = tickets.agg(
        F.lit("tickets").alias("channel"), F.count("*").alias("interactions"),
        F.count_distinct(F.when(weekday, F.col("case_owner"))).alias("agents"))
    c = chat_overview(chats).select(
        F.lit("chats").alias("channel"), F.col("total_chats").alias("interactions"),
        F.col("active_agents").cast("bigint").alias("agents"))
    whole = Window.partitionBy()
    both = t.unionByName(c)
    return both.withColumns({
        "total_interactions": F.sum("interactions").over(whole),
        "share_pct": values.percent(F.col("interactions"), F.sum("interactions").over(whole)),
        "total_agents": F.sum("agents").over(whole),
    })


def combined_report(tickets: DataFrame, chats: DataFrame, start: dt.datetime | None,
                    end: dt.datetime | None) -> DataFrame:
    """The summary row of each channel over the same range."""
    t = ticket_summary(filters.between(tickets, "create_ts_utc", start, end))
    c = chat_overview(filters.between(chats, "created_ts_utc", start, end))
    return t.withColumn("channel", F.lit("tickets")).unionByName(
        c.withColumn("channel", F.lit("chats")), allowMissingColumns=True)
