"""Canned questions and user SQL over registered views."""

from __future__ import annotations

import datetime as dt

from caseload.operators import sql_reports
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.sources.tables import register

_START, _END = dt.date(1998, 1, 1), dt.date(1999, 12, 31)
_RANGE = "create_ts_utc BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'"


def _views(spark, sf):
    register(fx.tickets(spark, sf), "tickets")
    register(fx.chats(spark, sf), "chats")


@query("r1_response_time", f"""
SELECT 'Time to first agent email reply (HH:mm:ss)' AS metric, count(*) AS ticket_count,
  avg(CASE WHEN reply_hms LIKE '%:%' THEN CAST(split_part(reply_hms, ':', 1) AS INT)
    + CAST(split_part(reply_hms, ':', 2) AS INT) / 60 END) AS avg_hours
FROM tickets WHERE reply_hms <> '' AND {_RANGE}""", "avg_hours")
def _(spark, sf):
    _views(spark, sf)
    return sql_reports.q_response_time(spark, _START, _END)


@query("r2_top_agents", """
SELECT ticket_owner, count(*) AS ticket_count, count(*) * 100.0 / sum(count(*)) OVER () AS percentage
FROM tickets WHERE ticket_owner <> '' GROUP BY 1 ORDER BY ticket_count DESC, ticket_owner LIMIT 10""", "percentage")
def _(spark, sf):
    _views(spark, sf)
    return sql_reports.q_top_agents(spark)


@query("r3_monthly_volume", """
SELECT CAST(date_trunc('month', create_ts_utc) AS DATE) AS month, count(*) AS ticket_count
FROM tickets GROUP BY 1 ORDER BY month DESC LIMIT 12""")
def _(spark, sf):
    _views(spark, sf)
    return sql_reports.q_monthly_volume(spark)


@query("r4_total", f"SELECT count(*) AS total_records FROM tickets WHERE {_RANGE}")
def _(spark, sf):
    _views(spark, sf)
    return sql_reports.q_total(spark, _START, _END)


@query("r5_user_sql", """
SELECT case_owner, pipeline, count(*) AS tickets, max(first_response_hours) AS slowest
FROM tickets WHERE priority = '1-URGENT' GROUP BY 1, 2 HAVING count(*) > 10""", "slowest")
def _(spark, sf):
    _views(spark, sf)
    return sql_reports.sql(spark, """
        SELECT case_owner, pipeline, count(*) AS tickets, max(first_response_hours) AS slowest
        FROM tickets WHERE priority = :priority GROUP BY case_owner, pipeline HAVING count(*) > :least""",
        priority="1-URGENT", least=10)
