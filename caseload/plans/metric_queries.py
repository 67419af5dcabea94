"""Metric extracts and data-quality checks over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload import schema
from caseload.operators import metrics
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.session import scratch_path

_M1 = """count(*) AS total_records, count(*) AS total_tickets, CAST(0 AS BIGINT) AS total_chats,
  count(*) FILTER (WHERE NOT is_weekend) AS weekday_records, count(*) FILTER (WHERE is_weekend) AS weekend_records"""
_M2 = """CAST(round(CAST(avg(first_response_hours) FILTER (WHERE first_response_hours > 0) AS DECIMAL(38,12)), 2) AS DOUBLE) AS avg_response_time_hours,
  CAST(round(CAST(median(first_response_hours) FILTER (WHERE first_response_hours > 0) AS DECIMAL(38,12)), 2) AS DOUBLE) AS median_response_time_hours,
  CAST(round(CAST(min(first_response_hours) FILTER (WHERE first_response_hours > 0) AS DECIMAL(38,12)), 3) AS DOUBLE) AS min_response_time_hours,
  CAST(round(CAST(max(first_response_hours) FILTER (WHERE first_response_hours > 0) AS DECIMAL(38,12)), 2) AS DOUBLE) AS max_response_time_hours,
  CAST(round(CAST(avg(first_response_hours) FILTER (WHERE is_weekend) AS DECIMAL(38,12)), 2) AS DOUBLE) AS weekend_avg_response_hours,
  CAST(round(CAST(avg(first_response_hours) FILTER (WHERE NOT is_weekend) AS DECIMAL(38,12)), 2) AS DOUBLE) AS weekday_avg_response_hours"""
_M2_DOUBLES = ("avg_response_time_hours median_response_time_hours min_response_time_hours max_response_time_hours "
               "weekend_avg_response_hours weekday_avg_response_hours")
_M3 = """
SELECT (SELECT case_owner FROM a ORDER BY n DESC, case_owner LIMIT 1) AS top_volume_agent,
  (SELECT max(n) FROM a) AS top_volume_count,
  (SELECT case_owner FROM a WHERE m IS NOT NULL ORDER BY m, case_owner LIMIT 1) AS fastest_agent,
  (SELECT CAST(round(CAST(min(m) AS DECIMAL(38,12)), 2) AS DOUBLE) FROM a) AS fastest_response_hours, (SELECT count(*) FROM a) AS agent_count,
  (SELECT string_agg(case_owner, ', ' ORDER BY n DESC, case_owner) FROM a) AS agents_list"""
_M3_WITH = """a AS (SELECT case_owner, count(*) AS n, median(first_response_hours) AS m FROM tickets
  WHERE case_owner IN ('Nova', 'Girly', 'Francis', 'Bhushan') GROUP BY 1)"""
_M4 = """CAST(round(CAST(count(*) FILTER (WHERE isodow(create_ts_local) < 6 AND hour(create_ts_local) BETWEEN 9 AND 16)
    * 100.0 / count(*) AS DECIMAL(38,12)), 1) AS DOUBLE) AS business_hours_percentage,
  CAST(round(CAST(count(*) FILTER (WHERE first_response_hours > 0 AND first_response_hours <= 1) * 100.0
    / count(*) FILTER (WHERE first_response_hours > 0) AS DECIMAL(38,12)), 1) AS DOUBLE) AS response_under_1hour_percentage,
  CAST(round(CAST(count(*) FILTER (WHERE first_response_hours > 0 AND first_response_hours <= 4) * 100.0
    / count(*) FILTER (WHERE first_response_hours > 0) AS DECIMAL(38,12)), 1) AS DOUBLE) AS response_under_4hour_percentage"""
_M4_DOUBLES = "business_hours_percentage response_under_1hour_percentage response_under_4hour_percentage"
_M5 = """count(first_response_hours) AS records_with_response_time,
  count(*) - count(first_response_hours) AS records_missing_data,
  CAST(round(CAST(count(first_response_hours) * 100.0 / count(*) AS DECIMAL(38,12)), 1) AS DOUBLE) AS data_quality_score"""


@query("m1_ticket_volume_metrics", f"SELECT {_M1} FROM tickets")
def _(spark, sf):
    return metrics.ticket_volume_metrics(fx.tickets(spark, sf))


@query("m2_response_metrics", f"SELECT {_M2} FROM tickets", _M2_DOUBLES)
def _(spark, sf):
    return metrics.response_metrics(fx.tickets(spark, sf))


@query("m3_agent_metrics", f"WITH {_M3_WITH} {_M3}", "fastest_response_hours")
def _(spark, sf):
    return metrics.agent_metrics(fx.tickets(spark, sf))


@query("m4_sla_metrics", f"SELECT {_M4} FROM tickets", _M4_DOUBLES)
def _(spark, sf):
    return metrics.sla_metrics(fx.tickets(spark, sf))


@query("m5_quality_metrics", f"SELECT {_M5} FROM tickets", "data_quality_score")
def _(spark, sf):
    return metrics.quality_metrics(fx.tickets(spark, sf))


_M6 = """
SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS total_tickets, count(*) AS total_chats,
  count(*) FILTER (WHERE isodow(date) < 6) AS weekday_records, count(*) FILTER (WHERE isodow(date) >= 6) AS weekend_records,
  CAST(sum(b) AS BIGINT) AS total_bot_chats, CAST(sum(h) AS BIGINT) AS total_human_chats,
  CAST(round(CAST(avg(rating_value) AS DECIMAL(38,12)), 1) AS DOUBLE) AS bot_satisfaction_rate, CAST(round(CAST(avg(duration_minutes) AS DECIMAL(38,12)), 1) AS DOUBLE) AS avg_chat_duration_minutes,
  CAST(round(CAST(sum(h) * 100.0 / count(*) AS DECIMAL(38,12)), 1) AS DOUBLE) AS bot_transfer_rate, CAST(round(CAST(sum(b) * 100.0 / count(*) AS DECIMAL(38,12)), 1) AS DOUBLE) AS bot_resolution_rate,
  CAST(round(CAST(avg(rating_value) AS DECIMAL(38,12)), 1) AS DOUBLE) AS human_satisfaction_rate,
  (SELECT country FROM chats WHERE country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_country,
  (SELECT count(*) AS n FROM chats WHERE country IS NOT NULL GROUP BY country ORDER BY n DESC LIMIT 1) AS top_country_count,
  (SELECT printf('%02d:00', hour) FROM chats GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour,
  (SELECT count(*) AS n FROM chats GROUP BY hour ORDER BY n DESC LIMIT 1) AS peak_hour_count
FROM (SELECT *,
  (display_agent ILIKE '%wynn ai%')::INT + (display_agent ILIKE '%agent scrape%')::INT
    + (display_agent ILIKE '%bot%')::INT + (display_agent ILIKE '%chatbot%')::INT AS b,
  (display_agent ILIKE '%nova%')::INT + (display_agent ILIKE '%girly%')::INT
    + (display_agent ILIKE '%francis%')::INT + (display_agent ILIKE '%bhushan%')::INT AS h FROM chats)"""


@query("m6_chat_metrics", _M6, "bot_satisfaction_rate avg_chat_duration_minutes bot_transfer_rate "
       "bot_resolution_rate human_satisfaction_rate")
def _(spark, sf):
    return metrics.chat_metrics(fx.chats(spark, sf))


_LOG_COLUMNS = ("run_id analytics_type total_records total_tickets weekday_records weekend_records "
                "avg_response_time_hours median_response_time_hours top_volume_agent agents_list "
                "business_hours_percentage data_quality_score top_country peak_hour total_bot_chats").split()


@query("m7_log_metrics", f"""
WITH {_M3_WITH}, t AS (SELECT {_M1}, {_M2}, {_M4}, {_M5} FROM tickets), m3 AS ({_M3}), c AS ({_M6})
SELECT 'run-t' AS run_id, 'tickets' AS analytics_type, total_records, total_tickets, weekday_records, weekend_records,
  avg_response_time_hours, median_response_time_hours, top_volume_agent, agents_list, business_hours_percentage,
  data_quality_score, NULL AS top_country, NULL AS peak_hour, NULL AS total_bot_chats FROM t, m3
UNION ALL SELECT 'run-c', 'chats', total_records, total_tickets, weekday_records, weekend_records, NULL, NULL, NULL,
  NULL, NULL, NULL, top_country, peak_hour, total_bot_chats FROM c""",
       "avg_response_time_hours median_response_time_hours business_hours_percentage data_quality_score")
def _(spark, sf):
    path = scratch_path(spark, "metrics-log")
    rows = [(metrics.ticket_metrics(fx.tickets(spark, sf)), "run-t", "tickets", fx.TICKETS_AS_OF),
            (metrics.chat_metrics(fx.chats(spark, sf)), "run-c", "chats", fx.CHATS_AS_OF)]
    for extract, run_id, kind, as_of in rows:
        metrics.log_metrics(metrics.metrics_row(extract, run_id, kind, as_of, "all", "All data"), path)
    return spark.read.schema(metrics.METRICS_SCHEMA).parquet(path).select(*_LOG_COLUMNS)


def _checks(table: str, requirements: dict[str, list[str]], key: str) -> str:
    parts = [f"SELECT '{r}' AS report, '{c}' AS column_name, true AS present, count({c}) AS filled, "
             f"count(*) AS rows, count(*) - count(DISTINCT {key}) AS duplicate_ids FROM {table}"
             for r, cols in requirements.items() for c in cols]
    return " UNION ALL ".join(parts)


@query("m8_diagnose_tickets", _checks("tickets", schema.TICKET_REQUIREMENTS, "ticket_id"))
def _(spark, sf):
    return metrics.diagnose(fx.tickets(spark, sf), schema.TICKET_REQUIREMENTS, "ticket_id")


@query("m8_diagnose_chats", _checks("chats", schema.CHAT_REQUIREMENTS, "chat_id"))
def _(spark, sf):
    return metrics.diagnose(fx.chats(spark, sf), schema.CHAT_REQUIREMENTS, "chat_id")


@query("m9_insights", """
WITH o AS (SELECT ticket_owner AS owner, count(*) AS ticket_count, avg(first_response_hours) AS mean_response_time
  FROM tickets WHERE ticket_owner IS NOT NULL GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS position, 'Top agents: ' || (SELECT string_agg(owner || ': 1', ', ' ORDER BY owner)
    FROM (SELECT owner FROM o ORDER BY owner LIMIT 3)) AS insight
UNION ALL SELECT 1, printf('Total ticket_count: %,d (highest single: %,d)', CAST(sum(ticket_count) AS BIGINT), max(ticket_count)) FROM o
UNION ALL SELECT 2, printf('Average response time: %.1f hours', avg(mean_response_time)) FROM o
UNION ALL SELECT 3, printf('Dataset: %d records analyzed', count(*)) FROM o""")
def _(spark, sf):
    result = fx.tickets(spark, sf).where("ticket_owner IS NOT NULL").groupBy(F.col("ticket_owner").alias("owner")).agg(
        F.count("*").alias("ticket_count"), F.avg("first_response_hours").alias("mean_response_time"))
    return metrics.insights(result)
