"""Ticket reports over the derived tickets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseload.operators import ticket_reports as reports
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.plans.oracle_views import MON

_TREND = """regr_slope(CAST({y} AS DOUBLE), x) OVER () * x + regr_intercept(CAST({y} AS DOUBLE), x) OVER ()"""


@query("a1_tickets_by_pipeline", "SELECT pipeline, count(*) AS tickets FROM desk GROUP BY 1")
def _(spark, sf):
    return reports.tickets_by_pipeline(fx.desk(spark, sf))


@query("a2_weekend_distribution", """
SELECT CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS category, count(*) AS tickets,
  count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM desk GROUP BY 1""", "share_pct")
def _(spark, sf):
    return reports.weekend_distribution(fx.desk(spark, sf))


@query("a3_daily_volume_trend", f"""
SELECT day, tickets, {_TREND.format(y='tickets')} AS trend
FROM (SELECT day, tickets, row_number() OVER (ORDER BY day) - 1 AS x
  FROM (SELECT CAST(create_ts_local AS DATE) AS day, count(*) AS tickets FROM desk GROUP BY 1))""", "trend")
def _(spark, sf):
    return reports.daily_volume_trend(fx.desk(spark, sf))


@query("a4_ticket_summary", """
SELECT *, total_tickets / span_days AS tickets_per_day, weekday_tickets / span_days AS weekday_per_day,
  weekend_tickets / span_days AS weekend_per_day
FROM (SELECT count(*) AS total_tickets, count(*) FILTER (WHERE is_weekend) AS weekend_tickets,
  count(*) FILTER (WHERE NOT is_weekend) AS weekday_tickets,
  avg(first_response_hours) FILTER (WHERE is_weekend) AS mean_response_weekend,
  CAST(floor(epoch(max(create_ts_local) - min(create_ts_local)) / 86400) AS BIGINT) + 1 AS span_days,
  count(DISTINCT case_owner) FILTER (WHERE NOT is_weekend) AS agent_count,
  median(first_response_hours) FILTER (WHERE NOT is_weekend AND rtrim(pipeline) IS DISTINCT FROM 'Live Chat')
    AS median_response_weekday
FROM desk)""", "tickets_per_day weekday_per_day weekend_per_day mean_response_weekend median_response_weekday")
def _(spark, sf):
    return reports.ticket_summary(fx.desk(spark, sf))


@query("a5_ticket_cards", """
SELECT count(*) AS total_tickets, count(*) FILTER (WHERE NOT is_weekend) AS weekday_tickets,
  count(*) FILTER (WHERE is_weekend) AS weekend_tickets, count(*) / 56 AS tickets_per_day,
  count(*) FILTER (WHERE NOT is_weekend) / 56 AS weekday_per_day,
  count(*) FILTER (WHERE is_weekend) / 56 AS weekend_per_day,
  median(first_response_hours) FILTER (WHERE NOT is_weekend AND rtrim(pipeline) IS DISTINCT FROM 'Live Chat')
    AS median_response_weekday
FROM tickets WHERE case_owner IN ('Bhushan', 'Girly', 'Nova', 'Francis')
  AND create_ts_utc BETWEEN TIMESTAMP '2001-08-02' - INTERVAL 56 DAY AND TIMESTAMP '2001-08-02'""",
       "tickets_per_day weekday_per_day weekend_per_day median_response_weekday")
def _(spark, sf):
    return reports.ticket_cards(fx.tickets(spark, sf), fx.TICKETS_AS_OF, 56)


_A6 = """
WITH weekday AS (SELECT * FROM desk WHERE NOT is_weekend),
by_pipe AS (SELECT case_owner, pipeline, count(*) AS n,
    row_number() OVER (PARTITION BY case_owner ORDER BY count(*) DESC, pipeline) AS r,
    count(*) OVER (PARTITION BY case_owner) AS kinds
  FROM weekday GROUP BY 1, 2),
span AS (SELECT CAST(floor(epoch(max(create_ts_local) - min(create_ts_local)) / 86400) AS BIGINT) + 1 AS d,
    count(*) AS n FROM weekday),
stats AS (SELECT case_owner, count(*) AS tickets, avg(v) AS m, median(v) AS md, stddev_samp(v) AS sd
  FROM (SELECT case_owner, CASE WHEN rtrim(pipeline) <> 'Live Chat' THEN first_response_hours END AS v FROM weekday)
  GROUP BY 1)
SELECT s.case_owner AS agent, tickets, CAST(round(CAST(tickets / (SELECT n FROM span) * 100 AS DECIMAL(38,12)), 1) AS DOUBLE) AS share_pct,
  CAST(round(CAST(tickets / (SELECT d FROM span) AS DECIMAL(38,12)), 1) AS DOUBLE) AS daily_average, CAST(round(CAST(m AS DECIMAL(38,12)), 2) AS DOUBLE) AS mean_response,
  CAST(round(CAST(md AS DECIMAL(38,12)), 2) AS DOUBLE) AS median_response, CAST(round(CAST(sd AS DECIMAL(38,12)), 2) AS DOUBLE) AS std_response,
  (SELECT string_agg(pipeline || '=' || n, '; ' ORDER BY n DESC, pipeline) FROM by_pipe p
    WHERE p.case_owner = s.case_owner) AS pipelines,
  (SELECT pipeline || ' (' || n || ')' || CASE WHEN kinds > 1 THEN ' +' || (kinds - 1) || ' more' ELSE '' END
    FROM by_pipe p WHERE p.case_owner = s.case_owner AND r = 1) AS top_pipeline
FROM stats s"""


def breakdown_text(df):
    """The pipeline map as text, so that both engines can compare it."""
    entries = F.map_entries("pipeline_breakdown")
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return df.withColumn("pipelines", text).drop("pipeline_breakdown")


@query("a6_agent_table", _A6, "share_pct daily_average mean_response median_response std_response")
def _(spark, sf):
    return breakdown_text(reports.agent_table(fx.desk(spark, sf)))


def _weekly(stat: str) -> str:
    value = f"{'median' if stat == 'median' else 'avg'}(first_response_hours)"
    overall = {v: f"(SELECT {value} FILTER (WHERE {c}) FROM desk)" for v, c in
               (("all", "true"), ("weekday", "NOT is_weekend"), ("weekend", "is_weekend"))}
    trends = ", ".join(
        f"CASE WHEN count({v}_{stat}) OVER () > 1 THEN {_TREND.format(y=f'{v}_{stat}')} "
        f"ELSE {overall[v]} END AS trend_{v}, {overall[v]} AS overall_{v}" for v in overall)
    return f"""
SELECT * EXCLUDE (x), {trends} FROM (SELECT *, row_number() OVER (ORDER BY week) - 1 AS x FROM (
  SELECT {MON.format('create_ts_local')} AS week,
    {value} AS all_{stat}, {value} FILTER (WHERE NOT is_weekend) AS weekday_{stat},
    {value} FILTER (WHERE is_weekend) AS weekend_{stat},
    count(first_response_hours) AS all_count,
    count(first_response_hours) FILTER (WHERE NOT is_weekend) AS weekday_count,
    count(first_response_hours) FILTER (WHERE is_weekend) AS weekend_count
  FROM desk GROUP BY 1))"""


for _stat in ("median", "mean"):
    _cols = " ".join(f"{v}_{_stat} trend_{v} overall_{v}" for v in ("all", "weekday", "weekend"))

    @query(f"a7_weekly_response_{_stat}", _weekly(_stat), _cols)
    def _(spark, sf, stat=_stat):
        return reports.weekly_response(fx.desk(spark, sf), stat)


@query("a8_weekend_response", f"""
SELECT * EXCLUDE (x), {_TREND.format(y='weekend_median')} AS trend
FROM (SELECT *, row_number() OVER (ORDER BY week) - 1 AS x FROM (
  SELECT {MON.format('create_ts_local')} AS week, median(first_response_hours) AS weekend_median,
    avg(first_response_hours) AS weekend_mean, count(first_response_hours) AS weekend_count
  FROM desk WHERE is_weekend GROUP BY 1) WHERE weekend_count > 0)""", "weekend_median weekend_mean trend")
def _(spark, sf):
    return reports.weekend_response(fx.desk(spark, sf))


@query("a9_top_delayed", """
SELECT ticket_id, first_response_hours, case_owner, create_ts_local, pipeline FROM desk
WHERE first_response_hours > 0 ORDER BY first_response_hours DESC, ticket_id LIMIT 5""", "first_response_hours")
def _(spark, sf):
    return reports.top_delayed(fx.desk(spark, sf))


@query("a10_agent_mean_response", """
SELECT case_owner AS agent, avg(first_response_hours) AS mean_response FROM desk WHERE NOT is_weekend
GROUP BY 1 HAVING avg(first_response_hours) IS NOT NULL""", "mean_response")
def _(spark, sf):
    return reports.agent_mean_response(fx.desk(spark, sf))


for _grain, _cut in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):

    @query(f"a11_volume_{_grain}", f"""
SELECT period, tickets, avg(tickets) OVER () AS mean_tickets, max(tickets) OVER () AS peak_tickets,
  CAST(sum(tickets) OVER () AS BIGINT) AS total_tickets
FROM (SELECT CAST(date_trunc('{_cut}', create_ts_utc) AS DATE) AS period, count(*) AS tickets FROM tickets GROUP BY 1)
ORDER BY period DESC LIMIT 10""", "mean_tickets")
    def _(spark, sf, grain=_grain):
        return reports.volume_by_grain(fx.tickets(spark, sf), grain)


@query("a12_owner_performance", """
SELECT ticket_owner AS owner, tickets, mean_response, share_pct FROM (
  SELECT ticket_owner, count(*) AS tickets, avg(first_response_hours) AS mean_response,
    count(*) * 100.0 / sum(count(*)) OVER () AS share_pct FROM tickets GROUP BY 1)
WHERE ticket_owner IS NOT NULL ORDER BY tickets DESC, owner LIMIT 10""", "mean_response share_pct")
def _(spark, sf):
    return reports.owner_performance(fx.tickets(spark, sf))


HMS_SQL = """CASE WHEN reply_hms LIKE '%:%' THEN
    TRY_CAST(split_part(reply_hms, ':', 1) AS DOUBLE) + TRY_CAST(split_part(reply_hms, ':', 2) AS DOUBLE) / 60
    + CASE WHEN len(string_split(reply_hms, ':')) = 3
        THEN TRY_CAST(split_part(reply_hms, ':', 3) AS DOUBLE) / 3600 ELSE 0 END
  ELSE TRY_CAST(reply_hms AS DOUBLE) END"""


@query("a13_hms_response_analysis", f"""
SELECT 'reply_hms' AS metric, avg(v) AS mean_hours, list_sort(list(v))[count(v) // 2 + 1] AS median_hours,
  count(v) AS tickets, CASE WHEN avg(v) < 1 THEN 'Excellent - Under 1 hour average'
    WHEN avg(v) < 4 THEN 'Good - Under 4 hour average' WHEN avg(v) < 24 THEN 'Moderate - Same day response'
    ELSE 'Slow - Over 24 hour average' END AS verdict
FROM (SELECT {HMS_SQL} AS v FROM tickets) WHERE v IS NOT NULL""", "mean_hours median_hours")
def _(spark, sf):
    return reports.hms_response_analysis(fx.tickets(spark, sf), ["reply_hms"])


@query("a13_hms_agent_means", f"""
SELECT agent, mean_hours, tickets FROM (SELECT ticket_owner AS agent, count(*) AS n, avg(v) AS mean_hours,
    count(v) AS tickets
  FROM (SELECT ticket_owner, CASE WHEN reply_hms LIKE '%:%' THEN {HMS_SQL} END AS v FROM tickets
    WHERE ticket_owner IS NOT NULL) GROUP BY 1 ORDER BY n DESC, agent LIMIT 5) WHERE tickets > 0""", "mean_hours")
def _(spark, sf):
    return reports.hms_agent_means(fx.tickets(spark, sf), "reply_hms")


@query("a14_period_analysis", """
SELECT * FROM (SELECT ticket_owner AS owner, count(*) AS tickets,
    CAST(sum(count(*)) OVER () AS BIGINT) AS total_tickets, sum(count(*)) OVER () / 1095 AS daily_average
  FROM tickets WHERE create_ts_utc BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-01-01' GROUP BY 1)
WHERE owner IS NOT NULL ORDER BY tickets DESC, owner LIMIT 5""", "daily_average")
def _(spark, sf):
    return reports.period_analysis(fx.tickets(spark, sf), dt.date(1997, 1, 1), dt.date(2000, 1, 1))


@query("a15_date_weekend_breakdown", """
SELECT CAST(create_ts_local AS DATE) AS date, count(*) AS total, count(*) FILTER (WHERE is_weekend) AS weekend,
  count(*) FILTER (WHERE NOT is_weekend) AS weekday FROM tickets GROUP BY 1""")
def _(spark, sf):
    return reports.date_weekend_breakdown(fx.tickets(spark, sf))


@query("j5_weekly_stats_joined", f"""
WITH a AS (SELECT {MON.format('create_ts_local')} AS week, avg(first_response_hours) AS m,
    count(first_response_hours) AS n FROM desk GROUP BY 1),
d AS (SELECT {MON.format('create_ts_local')} AS week, avg(first_response_hours) AS m,
    count(first_response_hours) AS n FROM desk WHERE NOT is_weekend GROUP BY 1),
e AS (SELECT {MON.format('create_ts_local')} AS week, avg(first_response_hours) AS m,
    count(first_response_hours) AS n FROM desk WHERE is_weekend GROUP BY 1)
SELECT a.week, a.m AS all_mean, a.n AS all_count, d.m AS weekday_mean, coalesce(d.n, 0) AS weekday_count,
  e.m AS weekend_mean, coalesce(e.n, 0) AS weekend_count
FROM a LEFT JOIN d ON d.week = a.week LEFT JOIN e ON e.week = a.week""", "all_mean weekday_mean weekend_mean")
def _(spark, sf):
    return reports.weekly_stats_joined(fx.desk(spark, sf))


@query("j6_volume_with_response", """
WITH v AS (SELECT case_owner, count(*) AS tickets FROM desk WHERE NOT is_weekend GROUP BY 1),
r AS (SELECT case_owner, avg(first_response_hours) AS m, stddev_samp(first_response_hours) AS s FROM desk
  WHERE NOT is_weekend AND rtrim(pipeline) <> 'Live Chat' GROUP BY 1)
SELECT v.case_owner AS agent, tickets, m AS mean_response, s AS std_response
FROM v LEFT JOIN r ON r.case_owner = v.case_owner""", "mean_response std_response")
def _(spark, sf):
    return reports.volume_with_response(fx.desk(spark, sf))
