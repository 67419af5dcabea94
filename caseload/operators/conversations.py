"""Conversation statistics, listings, context and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.operators.filters import ntz

ACTIVE_DAYS = 7
KEEP_DAYS = 30
PREVIEW = 100
SUMMARY = 200


def conversation_stats(convs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """V1: conversations, those not deleted, queries, and those updated in the last 7 whole days."""
    age = F.timestamp_diff("DAY", F.col("last_updated"), ntz(as_of))
    return convs.agg(
        F.count("*").alias("total_conversations"),
        F.count_if(~F.coalesce("deleted", F.lit(False))).alias("active_conversations"),
        F.coalesce(F.sum("query_count"), F.lit(0)).alias("total_queries"),
        F.count_if(age <= ACTIVE_DAYS).alias("recent_conversations"))


def conversations_from_messages(messages: DataFrame) -> DataFrame:
    """One row per conversation from its message rows (``conv_id, turn, author_type, text, ts``)."""
    customer = F.col("author_type") == "customer"
    return messages.groupBy("conv_id").agg(
        F.min("msg_ts_utc").alias("created_at"), F.max("msg_ts_utc").alias("last_updated"),
        F.count_if(customer).alias("query_count"),
        F.min_by("text", F.when(customer, F.col("turn"))).alias("first_question"))


def recent_conversations(convs: DataFrame, user_id=None, limit: int = 10) -> DataFrame:
    """V2: latest conversations (of one user) with a preview of the first question."""
    if user_id is not None:
        convs = convs.where(F.col("user_id") == user_id)
    preview = F.when(F.col("first_question").isNotNull(), F.concat(
        F.substring("first_question", 1, PREVIEW), F.lit("..."))).otherwise("Empty conversation")
    return convs.orderBy(F.desc("last_updated"), F.desc("conv_id")).limit(limit).select(
        "conv_id", "created_at", "last_updated", "query_count", preview.alias("preview"))


def exchanges(messages: DataFrame) -> DataFrame:
    """Question and answer pairs: each customer message with an agent's or bot's reply in the next turn.

    An equi-join on (conversation, turn) and not a window per conversation, so that a very long
    conversation is spread over all tasks.
    """
    asked = messages.where(F.col("author_type") == "customer").select(
        "conv_id", "turn", F.col("msg_ts_utc").alias("asked_at"), F.col("text").alias("question"))
    replies = messages.where(F.col("author_type").isin("agent", "bot")).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replies, ["conv_id", "turn"], "left").withColumn(
        "answer", F.coalesce("answer", F.lit("")))


def conversation_context(pairs: DataFrame, n: int = 5, insight: str | None = None) -> DataFrame:
    """V3: the last ``n`` exchanges of each conversation with a short summary of the answer."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = pairs.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    short = F.substring("answer", 1, SUMMARY)
    if insight:
        short = F.coalesce(F.nullif(F.col(insight), F.lit("")), short)
    return kept.select("conv_id", "turn", "question", short.alias("summary"), "asked_at")


def context_digest(pairs: DataFrame, n: int = 3) -> DataFrame:
    """V3: text of the last ``n`` exchanges, each side cut to 100 characters."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = pairs.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    side = lambda mark, c: F.concat(F.lit(mark), F.substring(c, 1, PREVIEW), F.lit("..."))
    text = F.concat(side("Q: ", "question"), F.lit("\n"), side("A: ", "answer"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", text.alias("t"))))
    return kept.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["t"]), "\n").alias("context_summary"))


def conversation_retain(convs: DataFrame, as_of: dt.datetime, days: int = KEEP_DAYS) -> DataFrame:
    """V4: conversations that are not deleted and were updated within ``days``."""
    fresh = F.col("last_updated") > ntz(as_of - dt.timedelta(days=days))
    return convs.where(~F.coalesce("deleted", F.lit(False)) & fresh)
