"""Support-desk tables derived from the benchmark tables, row by row and without sampling.

``orders`` become tickets, ``events`` become chats, logs and daily ratings, ``conversations`` become
messages. Everything is column arithmetic, so DuckDB can build the same rows (see ``oracles``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import chats as chat_ops
from caseload.operators import filters
from caseload.operators import tickets as ticket_ops

TICKETS_AS_OF = dt.datetime(2001, 8, 2)
CHATS_AS_OF = dt.datetime(2024, 1, 31)

# Declared, so that opening a table costs no job for schema inference.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _minutes(expr: str) -> str:
    return f"make_dt_interval(0, 0, CAST({expr} AS INT), 0)"


TICKET_OWNERS = ["Gillie", "Girly E", "Nora", "Nova", "Chris S", "Francis", "Shan D", "Bhushan", "Richie", None]
PIPELINES = ["0", "147307289", "648529801", "667370066", "724973238", "76337708", "77634704", "803109779",
             "Live Chat ", "95256452", "95947431"]
PRIMARY_AGENTS = ["Wynn AI", "Sales Agent", "Agent Scrape", "ChatBot", "Shan", "Chris", "Nora", "Gillie", "Spencer", None]


def _pick(key: str, names: list[str | None]) -> str:
    """The name at position ``key`` modulo the length of the list."""
    items = ", ".join("NULL" if n is None else f"'{n}'" for n in names)
    return f"get(array({items}), CAST({key} % {len(names)} AS INT))"


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = f"o_orderdate + {_minutes('(o_orderkey * 37) % 1440')}"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ticket_id",
        "concat(o_orderpriority, ' ', o_orderstatus) AS subject",
        "o_orderpriority AS priority",
        f"{created} AS create_ts_utc",
        f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate + "
        f"{_minutes('(o_orderkey * 37) % 1440 + (o_orderkey * 7919) % 4001 - 200')} END AS first_response_ts_utc",
        f"{created} + {_minutes('(o_orderkey * 101) % 20000')} AS last_modified_ts_utc",
        _pick("o_custkey", TICKET_OWNERS) + " AS ticket_owner",
        _pick("o_custkey", PIPELINES) + " AS pipeline_raw",
        "CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE concat("
        "lpad(CAST(((o_orderkey * 7919) % 4001) div 60 AS STRING), 2, '0'), ':', "
        "lpad(CAST(((o_orderkey * 7919) % 4001) % 60 AS STRING), 2, '0'), ':', "
        "lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) END AS reply_hms",
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickets, normalised."""
    return ticket_ops.normalize_tickets(raw_tickets(spark, sf_dir))


def desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of the support team without spam, the input of most reports."""
    return filters.support_team(filters.drop_spam(tickets(spark, sf_dir)))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets without spam under the Saturday-Sunday rule, the input of the agent comparison."""
    return filters.drop_spam(ticket_ops.weekend_simple(tickets(spark, sf_dir)))


def raw_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat per event; every chat of an error event is delivered twice."""
    events = table(spark, sf_dir, "events").withColumn(
        "load_seq", F.explode(F.expr("CASE WHEN event_type = 'error' THEN array(0, 1) ELSE array(0) END")))
    return events.selectExpr(
        "event_id AS chat_id", "load_seq", "ts AS created_ts_utc",
        _pick("user_id", PRIMARY_AGENTS) + " AS primary_agent_raw",
        _pick("event_id", ["Chris", "Nora", None, None, None, None]) + " AS secondary_agent_raw",
        _pick("event_id", ["Chris,Gillie", " nora n ", "Shan", "", "", ""]) + " AS human_agents",
        "CASE event_type WHEN 'signup' THEN 'rated good' WHEN 'error' THEN 'rated bad' WHEN 'view' THEN '4' "
        "WHEN 'click' THEN '9' ELSE 'not rated' END AS rate_raw",
        "CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST((event_id * 53) % 3600 + load_seq AS STRING) END "
        "AS duration_raw",
        "CAST((event_id * 7) % 600 AS STRING) AS first_response_raw",
        "CAST((event_id * 11) % 900 AS STRING) AS avg_response_raw",
        _pick("user_id", ["US", "CA", "GB", "IN", "PH", "US", None]) + " AS country",
        "CASE WHEN event_id % 5 = 0 THEN 'chatbot-transfer' END AS tag1",
        "CAST(NULL AS STRING) AS tag2",
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chat rows as delivered, normalised."""
    return chat_ops.normalize_chats(raw_chats(spark, sf_dir))


def ratings_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily ratings as the API returns them: one map per month, an entry per day."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(
        F.count_if(F.col("event_type") == "signup").alias("good"),
        F.count_if(F.col("event_type") == "error").alias("bad"))
    return days.groupBy(F.trunc("d", "month").alias("month")).agg(F.map_from_entries(F.collect_list(
        F.struct("d", F.struct("good", "bad")))).alias("records"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews; a second, contradicting review exists for every toxic label."""
    return table(spark, sf_dir, "labels").withColumn(
        "qa_seq", F.explode(F.expr("CASE WHEN toxic = 1 THEN array(1, 2) ELSE array(1) END"))).selectExpr(
        "doc_id AS ticket_id", "qa_seq",
        "CASE WHEN (quality = 1) = (qa_seq = 1) THEN 'Meets' ELSE 'Below' END AS `Overall Performance Rating`",
        "CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS `14. Tag for Systemic Review?`")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn",
        "CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN "
        "CASE WHEN conv_id % 3 = 0 THEN 'bot' ELSE 'agent' END ELSE 'system' END AS author_type",
        "text",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), 0, "
        "CAST(turn * 45 AS INT)) AS msg_ts_utc")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines; a processing run has 100 of them."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS log_id", "ts AS ts_utc",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'purchase' THEN 'SUCCESS' "
        "ELSE 'INFO' END AS level",
        "event_id div 100 AS run_id",
        "CASE event_id % 100 WHEN 0 THEN 'INIT' WHEN 99 THEN 'COMPLETE' ELSE 'PROCESSING' END AS stage",
        "concat('event ', event_type) AS message")


def ticket_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per ticket, some fields missing; finished orders come back as new tickets."""
    status = F.substring("subject", -1, 1)  # the subject ends in the order status
    return raw_tickets(spark, sf_dir).withColumn("o_orderstatus", status).selectExpr(
        "CASE WHEN o_orderstatus = 'F' THEN ticket_id + 1000000000 ELSE ticket_id END AS ticket_id",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('changed ', subject) END AS subject",
        "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE lower(priority) END AS priority",
        f"last_modified_ts_utc + {_minutes('60')} AS last_modified_ts_utc")


def ticket_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_tickets(spark, sf_dir).select("ticket_id", "subject", "priority", "last_modified_ts_utc")
