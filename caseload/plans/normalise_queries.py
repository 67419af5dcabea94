"""Scalar rules, row by row, over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload import dims, schema

from caseload.operators import chats as chat_ops
from caseload.operators import tickets as ticket_ops
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.plans.ticket_queries import HMS_SQL


def _raw(spark, sf):
    return fx.raw_tickets(spark, sf)


def _file_tickets(spark, sf):
    """The ticket table as a file export has it: file names and text only."""
    return _raw(spark, sf).selectExpr(
        "CAST(ticket_id AS STRING) AS `Ticket ID`", "subject AS `Subject`", "pipeline_raw AS `Pipeline`",
        "ticket_owner AS `Ticket owner`", "date_format(create_ts_utc, 'yyyy-MM-dd HH:mm:ss') AS `Create date`",
        "CASE WHEN priority = '5-LOW' THEN 'soon' ELSE date_format(first_response_ts_utc, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
        "END AS `First agent email response date`")


@query("n1_resolve_columns", """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, subject, pipeline_raw AS pipeline, ticket_owner, CAST(NULL AS VARCHAR) AS priority
FROM raw_tickets""")
def _(spark, sf):
    return schema.resolve_columns(_file_tickets(spark, sf), schema.TICKET_COLUMNS).select(
        "ticket_id", "subject", "pipeline", "ticket_owner", "priority")


@query("n1_resolve_chat_columns", """
SELECT chat_id, primary_agent_raw, CAST((TRY_CAST(duration_raw AS DOUBLE) / 60) * 60 AS DOUBLE) AS duration_seconds,
  country, tag1, CAST(NULL AS VARCHAR) AS tag2 FROM raw_chats""", "duration_seconds")
def _(spark, sf):
    minutes = F.col("duration_raw").try_cast("double") / 60
    export = fx.raw_chats(spark, sf).select(
        "chat_id", F.col("primary_agent_raw").alias("operator 1 nick"), minutes.alias("duration_minutes"),
        F.col("country").alias("visitor country code"), F.col("tag1").alias("tag 1"))
    return schema.resolve_columns(export, schema.CHAT_COLUMNS).select(
        "chat_id", "primary_agent_raw", F.col("duration_raw").cast("double").alias("duration_seconds"),
        "country", "tag1", "tag2")


@query("n2_rename", """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, subject, pipeline_raw AS pipeline, ticket_owner AS case_owner,
  strftime(create_ts_utc, '%Y-%m-%d %H:%M:%S') AS create_date,
  CASE WHEN priority = '5-LOW' THEN 'soon' ELSE strftime(first_response_ts_utc, '%Y-%m-%dT%H:%M:%SZ') END
    AS first_agent_response_date FROM raw_tickets""")
def _(spark, sf):
    # To file names and back again.
    return schema.to_store_names(schema.to_file_names(schema.to_store_names(_file_tickets(spark, sf))))


@query("n3_ticket_tz", """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, create_ts_utc, create_ts_local,
  CASE WHEN priority <> '5-LOW' THEN first_response_ts_utc END AS first_response_ts_utc,
  CASE WHEN priority <> '5-LOW' THEN (first_response_ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' END
    AS first_response_ts_local FROM tickets""")
def _(spark, sf):
    """From text; what does not parse is NULL."""
    logical = schema.resolve_columns(_file_tickets(spark, sf), schema.TICKET_COLUMNS)
    return ticket_ops.ticket_tz(logical).select(
        "ticket_id", "create_ts_utc", "create_ts_local", "first_response_ts_utc", "first_response_ts_local")


# The zone database answers for hours that exist once; the two odd hours of a year follow the rule.
@query("n4_central_to_eastern", """
SELECT ticket_id, wall,
  CASE WHEN gap THEN date_trunc('day', wall) + INTERVAL 4 HOUR
       WHEN twice THEN wall + INTERVAL 1 HOUR
       ELSE ((wall AT TIME ZONE 'America/Chicago') AT TIME ZONE 'America/New_York') END AS eastern
FROM (SELECT *, hour(wall) = 2 AND (((wall AT TIME ZONE 'America/Chicago') AT TIME ZONE 'America/Chicago') <> wall) AS gap,
    hour(wall) = 1 AND month(wall) = 10 AND isodow(wall) = 7 AND day(wall) > 24 AS twice
  FROM (SELECT ticket_id, create_ts_utc AS wall FROM raw_tickets))""")
def _(spark, sf):
    rows = _raw(spark, sf).select("ticket_id", F.col("create_ts_utc").alias("wall"), F.col("create_ts_utc").alias("eastern"))
    return ticket_ops.central_to_eastern(rows, ["eastern"])


@query("n5_canonical_utc", """
SELECT ticket_id, create_ts_utc AS ticket_created_at_utc, strftime(create_ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS ticket_created_at_iso
FROM raw_tickets""")
def _(spark, sf):
    rows = _raw(spark, sf).select("ticket_id", "create_ts_utc")
    return ticket_ops.canonical_utc(rows, "create_ts_utc", "ticket_created_at").drop("create_ts_utc")


@query("n6_chat_tz", """
SELECT chat_id, load_seq, created_ts_utc, created_ts_local, strftime(created_ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS created_iso,
  CASE WHEN rate_raw <> '9' THEN created_ts_utc END AS started_ts_utc FROM chats""")
def _(spark, sf):
    """The first creation candidate that parses: raw text for some chats, ISO text for the others."""
    stamp = "date_format(created_ts_utc, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    rows = fx.raw_chats(spark, sf).selectExpr(
        "chat_id", "load_seq",
        f"CASE WHEN rate_raw = '4' THEN 'unknown' WHEN rate_raw = 'rated bad' THEN '' ELSE {stamp} END AS created_raw",
        f"CASE WHEN rate_raw IN ('4', 'rated bad') THEN concat({stamp}, 'Z') END AS created_iso",
        f"CASE WHEN rate_raw = '9' THEN 'never' ELSE {stamp} END AS started_raw")
    return chat_ops.chat_tz(rows).select(
        "chat_id", "load_seq", "created_ts_utc", "created_ts_local", "created_iso", "started_ts_utc")


@query("n7_chat_date_parts", "SELECT chat_id, load_seq, date, hour, day_of_week FROM chats")
def _(spark, sf):
    return chat_ops.chat_date_parts(chat_ops.chat_tz(fx.raw_chats(spark, sf))).select(
        "chat_id", "load_seq", "date", "hour", "day_of_week")


@query("n8_map_staff", "SELECT ticket_id, ticket_owner, case_owner FROM tickets")
def _(spark, sf):
    return ticket_ops.map_staff(_raw(spark, sf)).select("ticket_id", "ticket_owner", "case_owner")


@query("n9_normalize_cs_agents", """
SELECT ticket_id, CASE WHEN lower(ticket_owner) IN ('nora', 'nova') THEN 'Nova'
  WHEN lower(ticket_owner) IN ('gillie', 'girly e') THEN 'Girly' WHEN lower(ticket_owner) IN ('chris s', 'francis') THEN 'Francis'
  ELSE 'Bhushan' END AS ticket_owner
FROM raw_tickets WHERE lower(ticket_owner) NOT LIKE '%richie%'""")
def _(spark, sf):
    odd = F.concat(F.lit(" "), F.upper("ticket_owner"), F.lit(" "))
    rows = _raw(spark, sf).select("ticket_id", odd.alias("ticket_owner"))
    return ticket_ops.normalize_cs_agents(rows, "ticket_owner")


@query("n10_map_pipelines", "SELECT ticket_id, pipeline_raw, pipeline FROM tickets")
def _(spark, sf):
    return ticket_ops.map_pipelines(_raw(spark, sf)).select("ticket_id", "pipeline_raw", "pipeline")


@query("n11_display_pipeline", """
SELECT ticket_id, CASE trim(p) WHEN 'Support Pipeline' THEN 'Support' WHEN 'Enterprise and VIP Tickets' THEN 'Enterprise/VIP'
  WHEN 'Dev Tickets' THEN 'Dev' ELSE coalesce(trim(p), 'Unknown') END AS pipeline
FROM (SELECT ticket_id, CASE pipeline WHEN 'Success' THEN NULL WHEN 'SPAM Tickets' THEN 'SPAM' ELSE pipeline END AS p FROM tickets)
WHERE p IS DISTINCT FROM 'SPAM'""")
def _(spark, sf):
    rows = fx.tickets(spark, sf).selectExpr(
        "ticket_id", "CASE pipeline WHEN 'Success' THEN NULL WHEN 'SPAM Tickets' THEN 'SPAM' ELSE pipeline END AS pipeline")
    return ticket_ops.display_pipeline(rows)


@query("n12_weekend_flag", "SELECT ticket_id, create_ts_local, is_weekend FROM tickets")
def _(spark, sf):
    return fx.tickets(spark, sf).select("ticket_id", "create_ts_local", "is_weekend")


@query("n13_weekend_simple", "SELECT ticket_id, isodow(create_ts_local) >= 6 AS is_weekend FROM tickets")
def _(spark, sf):
    return ticket_ops.weekend_simple(fx.tickets(spark, sf)).select("ticket_id", "is_weekend")


@query("n14_off_shift", """
SELECT ticket_id, is_weekend OR NOT CASE case_owner
  WHEN 'Nova' THEN m >= 630 AND m < CASE WHEN d = 5 THEN 1080 ELSE 1140 END
  WHEN 'Girly' THEN m >= 510 AND m < 1020
  WHEN 'Bhushan' THEN m >= 270 AND m < 780
  WHEN 'Francis' THEN d < 5 AND (m >= 1110 OR m < 300)
  ELSE m >= 270 AND m < CASE WHEN d = 5 THEN 1080 ELSE 1140 END END AS off_shift
FROM (SELECT ticket_id, coalesce(case_owner, '') AS case_owner, is_weekend, isodow(create_ts_local) AS d,
  hour(create_ts_local) * 60 + minute(create_ts_local) AS m FROM tickets)""")
def _(spark, sf):
    return ticket_ops.off_shift(fx.tickets(spark, sf)).select("ticket_id", "off_shift")


@query("n15_first_response", "SELECT ticket_id, first_response_hours FROM tickets", "first_response_hours")
def _(spark, sf):
    return fx.tickets(spark, sf).select("ticket_id", "first_response_hours")


@query("n15_first_response_strict", """
SELECT ticket_id, CASE WHEN pipeline = 'Live Chat ' THEN 30.0 / 3600 WHEN first_response_ts_utc > create_ts_utc
  THEN epoch(first_response_ts_utc - create_ts_utc) / 3600 END AS first_response_hours FROM tickets""",
       "first_response_hours")
def _(spark, sf):
    return ticket_ops.first_response(fx.tickets(spark, sf), strict_space=True).select("ticket_id", "first_response_hours")


@query("n16_hms_to_hours", f"SELECT ticket_id, reply_hms, {HMS_SQL} AS reply_hours FROM raw_tickets", "reply_hours")
def _(spark, sf):
    return ticket_ops.hms_to_hours(_raw(spark, sf).select("ticket_id", "reply_hms"))


@query("n17_classify_agent", "SELECT chat_id, load_seq, primary_agent, secondary_agent, agent_type FROM chats")
def _(spark, sf):
    return chat_ops.classify_agent(fx.raw_chats(spark, sf)).select(
        "chat_id", "load_seq", "primary_agent", "secondary_agent", "agent_type")


@query("n18_display_agent", "SELECT chat_id, load_seq, primary_agent, display_agent FROM chats")
def _(spark, sf):
    return chat_ops.display_agent(chat_ops.classify_agent(fx.raw_chats(spark, sf))).select(
        "chat_id", "load_seq", "primary_agent", "display_agent")


@query("n19_classify_by_keyword", """
SELECT chat_id, load_seq, CASE WHEN regexp_matches(lower(display_agent), 'ai|bot|wynn') THEN 'bot' ELSE 'human' END AS repair_type,
  CASE WHEN regexp_matches(lower(display_agent), 'bot|ai|wynn|scrape|automated') THEN 'bot' ELSE 'human' END AS metric_type
FROM chats""")
def _(spark, sf):
    rows = fx.chats(spark, sf).select("chat_id", "load_seq", "display_agent")
    rows = chat_ops.classify_by_keyword(rows, "display_agent", dims.REPAIR_BOT_WORDS, "repair_type")
    return chat_ops.classify_by_keyword(rows, "display_agent", dims.METRIC_BOT_WORDS, "metric_type").drop("display_agent")


@query("n20_normalize_rating", "SELECT chat_id, load_seq, rate_raw, rating_value, has_rating FROM chats", "rating_value")
def _(spark, sf):
    return chat_ops.normalize_rating(fx.raw_chats(spark, sf)).select(
        "chat_id", "load_seq", "rate_raw", "rating_value", "has_rating")


@query("n21_score_to_text", """
SELECT event_id, score, CASE WHEN score >= 4 THEN 'rated good' WHEN score <= 2 THEN 'rated bad' ELSE 'not rated' END AS rate_raw
FROM (SELECT event_id, CASE WHEN user_id % 6 > 0 THEN user_id % 6 END AS score FROM events)""")
def _(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("event_id", "CASE WHEN user_id % 6 > 0 THEN user_id % 6 END AS score")
    return chat_ops.score_to_text(rows)


@query("n22_transfer_flag", "SELECT chat_id, load_seq, bot_transfer FROM chats")
def _(spark, sf):
    return chat_ops.transfer_flag(chat_ops.classify_agent(fx.raw_chats(spark, sf))).select(
        "chat_id", "load_seq", "bot_transfer")


@query("n23_durations", """
SELECT chat_id, load_seq, duration_seconds, duration_minutes, first_response_seconds, avg_response_seconds FROM chats""",
       "duration_seconds duration_minutes first_response_seconds avg_response_seconds")
def _(spark, sf):
    return chat_ops.durations(fx.raw_chats(spark, sf)).select(
        "chat_id", "load_seq", "duration_seconds", "duration_minutes", "first_response_seconds", "avg_response_seconds")


@query("n25_calendar_fields", """
SELECT ticket_id, isodow(t) AS day_number, dayname(t) AS day_name, isodow(t) >= 6 AS is_weekend_day, isodow(t) < 6 AS is_weekday,
  quarter(t) AS fy_quarter, 'Q' || quarter(t) AS fy_quarter_name, year(t) AS fy_year, year(t) || '-Q' || quarter(t) AS fy_quarter_full,
  month(t) AS month_number, monthname(t) AS month_name, strftime(t, '%Y-%m (%B)') AS month_year
FROM (SELECT ticket_id, create_ts_local AS t FROM tickets)""")
def _(spark, sf):
    rows = fx.tickets(spark, sf).select("ticket_id", "create_ts_local")
    return ticket_ops.calendar_fields(rows, "create_ts_local").drop("create_ts_local")


@query("n26_response_bins", """
SELECT ticket_id, CAST(round(CAST(h AS DECIMAL(38,12)), 2) AS DOUBLE) AS response_hours_clean, CAST(round(CAST(h / 24 AS DECIMAL(38,12)), 2) AS DOUBLE) AS response_days,
  CASE WHEN h <= 1 THEN '< 1 hour' WHEN h <= 4 THEN '1-4 hours' WHEN h <= 24 THEN '4-24 hours' WHEN h <= 72 THEN '1-3 days'
    WHEN h > 72 THEN '3+ days' END AS response_category
FROM (SELECT ticket_id, first_response_hours AS h FROM tickets)""", "response_hours_clean response_days")
def _(spark, sf):
    rows = fx.tickets(spark, sf).select("ticket_id", "first_response_hours")
    return ticket_ops.response_bins(rows).drop("first_response_hours")


@query("n27_time_period", """
SELECT chat_id, load_seq, hour, CASE WHEN hour <= 6 THEN 'Night (0-6)' WHEN hour <= 12 THEN 'Morning (6-12)'
  WHEN hour <= 18 THEN 'Afternoon (12-18)' ELSE 'Evening (18-24)' END AS time_period FROM chats""")
def _(spark, sf):
    return chat_ops.time_period(fx.chats(spark, sf)).select("chat_id", "load_seq", "hour", "time_period")


@query("n28_business_hours", """
SELECT ticket_id, isodow(create_ts_local) < 6 AND hour(create_ts_local) BETWEEN 9 AND 16 AS in_business_hours FROM tickets""")
def _(spark, sf):
    return ticket_ops.business_hours(fx.tickets(spark, sf)).select("ticket_id", "in_business_hours")


@query("n29_ticket_age", """
SELECT ticket_id, CAST(round(CAST(epoch(TIMESTAMP '2001-08-02' - create_ts_utc) / 86400 AS DECIMAL(38,12)), 1) AS DOUBLE) AS ticket_age_days FROM raw_tickets""",
       "ticket_age_days")
def _(spark, sf):
    return ticket_ops.ticket_age(_raw(spark, sf), fx.TICKETS_AS_OF).select("ticket_id", "ticket_age_days")


@query("n31_ensure_ticket_columns", "SELECT ticket_id, is_weekend, create_ts_local, first_response_hours FROM tickets",
       "first_response_hours")
def _(spark, sf):
    bare = fx.tickets(spark, sf).select(
        "ticket_id", "create_ts_utc", F.col("first_response_hours").cast("string").alias("first_response_hours"))
    return schema.ensure_ticket_columns(bare).drop("create_ts_utc")


@query("n31_ensure_chat_columns", """
SELECT chat_id, load_seq, rating_value, has_rating, bot_transfer, duration_minutes,
  CASE WHEN regexp_matches(lower(display_agent), 'ai|bot|wynn') THEN 'bot' ELSE 'human' END AS agent_type FROM chats""",
       "rating_value duration_minutes")
def _(spark, sf):
    bare = fx.chats(spark, sf).select(
        "chat_id", "load_seq", "rate_raw", "display_agent", F.col("bot_transfer").cast("int").alias("bot_transfer"),
        F.col("duration_minutes").cast("string").alias("duration_minutes"))
    return schema.ensure_chat_columns(bare).drop("rate_raw", "display_agent")
