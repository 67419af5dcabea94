"""Parameterised reports over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.operators import joins
from caseload.operators import widgets as w
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.plans.oracle_views import MON, TUE
from caseload.sources import payloads

_ALL = "true"
# Ranges relative to 2001-08-02 00:00 UTC (2001-08-01 20:00 Eastern summer time, UTC-4).
_T = {
    "all": _ALL,
    "12w": "create_ts_utc BETWEEN TIMESTAMP '2001-05-09 04:00' AND TIMESTAMP '2001-08-02'",
    "26w": "create_ts_utc BETWEEN TIMESTAMP '2001-01-31 04:00' AND TIMESTAMP '2001-08-02'",
    "52w": "create_ts_utc BETWEEN TIMESTAMP '2000-08-02 04:00' AND TIMESTAMP '2001-08-02'",
    "7d": "create_ts_utc BETWEEN TIMESTAMP '2001-07-23 04:00' AND TIMESTAMP '2001-08-02'",
    "13w": "create_ts_utc BETWEEN TIMESTAMP '2000-10-01 04:00' AND TIMESTAMP '2001-08-02'",
    "ytd": "create_ts_utc BETWEEN TIMESTAMP '2001-01-01 05:00' AND TIMESTAMP '2001-08-02'",
}
# Ranges relative to 2024-01-31 00:00 UTC (2024-01-30 20:00 Atlantic standard time, UTC-4).
_C = {
    "all": _ALL,
    "12w": "created_ts_utc BETWEEN TIMESTAMP '2023-11-07 04:00' AND TIMESTAMP '2024-01-31'",
    "13w": "created_ts_utc BETWEEN TIMESTAMP '2023-04-01 03:00' AND TIMESTAMP '2024-01-31'",
    "ytd": "created_ts_utc BETWEEN TIMESTAMP '2024-01-01 04:00' AND TIMESTAMP '2024-01-31'",
}
_TUE_T, _TUE_C = TUE.format("create_ts_local"), TUE.format("created_ts_local")
_MON_T = MON.format("create_ts_local")
_TREND = "regr_slope(CAST({y} AS DOUBLE), x) OVER () * x + regr_intercept(CAST({y} AS DOUBLE), x) OVER () AS trend"
_ISO = "strftime(period, '%Y-%m-%d')"
_Q = "'Q' || quarter(period) || ' ' || year(period)"


def _t(spark, sf):
    return fx.desk(spark, sf)


def _c(spark, sf):
    """Canonical chats only: the order of delivery is unknown."""
    return fx.chats(spark, sf).drop("load_seq")


def _odd(spark, sf):
    """Some tickets belong to a pipeline without a label."""
    name = "CASE WHEN pipeline = 'Success' THEN '999888' ELSE pipeline END"
    return _t(spark, sf).withColumn("pipeline", F.expr(name))


def _ratings(spark, sf):
    return payloads.explode_ratings(fx.ratings_map(spark, sf))


@query("w1_volume_daily_historic_tickets", """
SELECT CAST(create_ts_local AS DATE) AS day, count(*) AS rows FROM shown GROUP BY 1""")
def _(spark, sf):
    return w.volume_daily_historic(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w1_volume_daily_historic_chats", f"""
SELECT CAST(created_ts_local AS DATE) AS day, count(*) AS rows FROM first_chats
WHERE isodow(created_ts_local) < 6 AND {_C['ytd']} GROUP BY 1""")
def _(spark, sf):
    return w.volume_daily_historic(
        _c(spark, sf), fx.CHATS_AS_OF, range_="ytd", source="chats", include_weekends=False)


@query("w2_tickets_by_pipeline", f"""
SELECT pipeline, count(*) AS tickets FROM shown WHERE {_T['52w']} GROUP BY 1""")
def _(spark, sf):
    return w.tickets_by_pipeline(_t(spark, sf), fx.TICKETS_AS_OF, range_="52w")


@query("w3_weekday_weekend_distribution", f"""
SELECT CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS category, count(*) AS tickets,
  count(*) * 100.0 / sum(count(*)) OVER () AS share_pct FROM shown WHERE {_T['ytd']} GROUP BY 1""", "share_pct")
def _(spark, sf):
    return w.weekday_weekend_distribution(_t(spark, sf), fx.TICKETS_AS_OF, range_="ytd")


def _w4(period: str, where: str, agg: str, label: str = _ISO, tail: str = "") -> str:
    return f"""
SELECT period, response_hours, {label} AS label, {_TREND.format(y='response_hours')}
FROM (SELECT *, row_number() OVER (ORDER BY period) - 1 AS x
  FROM (SELECT * FROM (SELECT {period} AS period, {agg}(first_response_hours) AS response_hours FROM shown
    WHERE {where} AND first_response_hours > 0 GROUP BY 1) {tail}))"""


@query("w4_weekly_response_breakdown", _w4(_TUE_T, "NOT is_weekend", "median"), "response_hours trend")
def _(spark, sf):
    return w.weekly_response_breakdown(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w4_weekly_response_breakdown_weekend_mean", _w4(_TUE_T, f"is_weekend AND {_T['12w']}", "avg"),
       "response_hours trend")
def _(spark, sf):
    return w.weekly_response_breakdown(_t(spark, sf), fx.TICKETS_AS_OF, range_="12w", view="weekend", stat="mean")


@query("w4_weekly_response_breakdown_quarterly",
       _w4("CAST(date_trunc('quarter', create_ts_local) AS DATE)", f"NOT is_weekend AND {_T['13w']}", "median", _Q,
           "ORDER BY period DESC LIMIT 4"), "response_hours trend")
def _(spark, sf):
    return w.weekly_response_breakdown(_t(spark, sf), fx.TICKETS_AS_OF, range_="13w")


@query("w4_weekly_response_breakdown_daily",
       _w4("CAST(create_ts_local AS DATE)", f"NOT is_weekend AND isodow(create_ts_local) < 6 AND {_T['7d']}", "median"),
       "response_hours trend")
def _(spark, sf):
    return w.weekly_response_breakdown(_t(spark, sf), fx.TICKETS_AS_OF, range_="7d")


@query("w5_agent_ticket_volume_distribution", """
SELECT case_owner AS agent, count(*) AS tickets FROM shown WHERE NOT is_weekend GROUP BY 1""")
def _(spark, sf):
    return w.agent_ticket_volume_distribution(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w6_agent_response_time_comparison", """
SELECT case_owner AS agent, median(first_response_hours) AS median_hours FROM shown
WHERE pipeline <> 'Live Chat' AND first_response_hours > 0 GROUP BY 1""", "median_hours")
def _(spark, sf):
    return w.agent_response_time_comparison(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


def _w7(period: str, where: str, label: str) -> str:
    return f"""
SELECT period, {label} AS label, total, bot, human, {_TREND.format(y='total')}
FROM (SELECT {period} AS period, count(*) AS total, count(*) FILTER (WHERE NOT bot_transfer) AS bot,
    count(*) FILTER (WHERE bot_transfer) AS human, row_number() OVER (ORDER BY {period}) - 1 AS x
  FROM first_chats WHERE {where} GROUP BY 1)"""


@query("w7_chat_weekly_volume_breakdown", _w7(_TUE_C, _C["12w"], _ISO), "trend")
def _(spark, sf):
    return w.chat_weekly_volume_breakdown(_c(spark, sf), fx.CHATS_AS_OF, range_="12w")


@query("w7_chat_weekly_volume_breakdown_quarterly",
       _w7("CAST(date_trunc('quarter', created_ts_local) AS DATE)", _C["13w"], _Q), "trend")
def _(spark, sf):
    return w.chat_weekly_volume_breakdown(_c(spark, sf), fx.CHATS_AS_OF, range_="13w")


def _w8(source: str, period: str, label: str) -> str:
    return f"""
SELECT period, {label} AS label, CAST(sum(total) AS BIGINT) AS total_ratings,
  sum(good) * 100.0 / sum(total) AS satisfaction_pct
FROM (SELECT *, {period} AS period FROM ({source})) GROUP BY period"""


_RANGE_DAYS = "SELECT * FROM ratings WHERE date BETWEEN DATE '2023-11-07' AND DATE '2024-01-30'"


@query("w8_weekly_bot_satisfaction", _w8(_RANGE_DAYS, TUE.format("CAST(date AS TIMESTAMP)"), _ISO), "satisfaction_pct")
def _(spark, sf):
    return w.weekly_bot_satisfaction(_ratings(spark, sf), fx.CHATS_AS_OF, range_="12w")


@query("w8_weekly_bot_satisfaction_quarterly",
       _w8("SELECT * FROM ratings WHERE date BETWEEN DATE '2023-04-01' AND DATE '2024-01-30'",
           "CAST(date_trunc('quarter', date) AS DATE)", _Q), "satisfaction_pct")
def _(spark, sf):
    return w.weekly_bot_satisfaction(_ratings(spark, sf), fx.CHATS_AS_OF, range_="13w")


@query("w8_weekly_bot_satisfaction_daily",
       _w8("SELECT * FROM ratings WHERE date BETWEEN DATE '2024-01-19' AND DATE '2024-01-30' "
           "ORDER BY date DESC LIMIT 7", "date", _ISO), "satisfaction_pct")
def _(spark, sf):
    return w.weekly_bot_satisfaction(_ratings(spark, sf), fx.CHATS_AS_OF, range_="7d")


@query("w8_weekly_bot_satisfaction_all",
       _w8("SELECT * FROM ratings", TUE.format("CAST(date AS TIMESTAMP)"), _ISO), "satisfaction_pct")
def _(spark, sf):
    return w.weekly_bot_satisfaction(_ratings(spark, sf), fx.CHATS_AS_OF, range_="all")


@query("w9_bot_volume_duration", f"""
SELECT display_agent AS bot, count(*) AS chats, avg(duration_minutes) AS mean_duration FROM first_chats
WHERE agent_type = 'bot' AND {_C['12w']} GROUP BY 1""", "mean_duration")
def _(spark, sf):
    return w.bot_volume_duration(_c(spark, sf), fx.CHATS_AS_OF)


@query("w10_human_volume_duration", f"""
SELECT CASE WHEN a IN ('gillie', 'gillie e', 'girly', 'girly e') THEN 'Girly'
  WHEN a IN ('nora', 'nora n', 'nova') THEN 'Nova' WHEN a IN ('shan', 'shan d', 'bhushan') THEN 'Bhushan'
  ELSE 'Francis' END AS agent, count(*) AS chats, avg(duration_minutes) AS mean_duration
FROM (SELECT *, trim(lower(unnest(string_split(human_agents, ',')))) AS a FROM first_chats
  WHERE human_agents <> '' AND {_C['12w']})
WHERE a IN ('gillie', 'nora n', 'shan', 'chris') GROUP BY 1""", "mean_duration")
def _(spark, sf):
    return w.human_volume_duration(_c(spark, sf), fx.CHATS_AS_OF)


@query("w11_agent_weekly_response_by_agent", f"""
SELECT {_TUE_T} AS week, case_owner AS agent, median(first_response_hours) AS median_hours FROM shown
WHERE first_response_hours > 0 GROUP BY 1, 2""", "median_hours")
def _(spark, sf):
    return w.agent_weekly_response_by_agent(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w12_agent_weekly_ticket_volume_by_agent", f"""
SELECT period, agent, tickets, {_ISO} AS label FROM (SELECT {_TUE_T} AS period, case_owner AS agent,
  count(*) AS tickets FROM shown GROUP BY 1, 2)""")
def _(spark, sf):
    return w.agent_weekly_ticket_volume_by_agent(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w12_agent_weekly_ticket_volume_by_agent_quarterly", f"""
SELECT period, agent, tickets, {_Q} AS label FROM (
  SELECT CAST(date_trunc('quarter', create_ts_local) AS DATE) AS period, case_owner AS agent, count(*) AS tickets
  FROM shown WHERE {_T['13w']} GROUP BY 1, 2)""")
def _(spark, sf):
    return w.agent_weekly_ticket_volume_by_agent(_t(spark, sf), fx.TICKETS_AS_OF, range_="13w")


@query("w13_performance_vs_volume", "SELECT case_owner AS agent, count(*) AS tickets FROM shown GROUP BY 1")
def _(spark, sf):
    return w.performance_vs_volume(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w14_daily_chat_trends_performance", f"""
SELECT d.*, coalesce(r.satisfaction_pct, 0) AS satisfaction_pct FROM (
  SELECT date, count(*) AS chats, count(*) FILTER (WHERE bot_transfer) AS transfers,
    count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate
  FROM first_chats WHERE {_C['ytd']} GROUP BY 1) d
LEFT JOIN ratings r ON r.date = d.date AND r.date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'""",
       "transfer_rate satisfaction_pct")
def _(spark, sf):
    return w.daily_chat_trends_performance(
        _c(spark, sf), _ratings(spark, sf), fx.CHATS_AS_OF, range_="ytd")


@query("w14_daily_chat_trends_performance_all", """
SELECT d.*, coalesce(r.satisfaction_pct, 0) AS satisfaction_pct FROM (
  SELECT date, count(*) AS chats, count(*) FILTER (WHERE bot_transfer) AS transfers,
    count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate
  FROM first_chats GROUP BY 1) d LEFT JOIN ratings r ON r.date = d.date""", "transfer_rate satisfaction_pct")
def _(spark, sf):
    return w.daily_chat_trends_performance(
        _c(spark, sf), _ratings(spark, sf), fx.CHATS_AS_OF, range_="all")


_LABELS = ["999888", "Customer Onboarding", "Dev", "Enterprise/VIP", "Live Chat", "Marketing, Finance",
           "Product Testing Requests - Enterprise", "Support", "Upgrades/Downgrades"]
_ODD = "(SELECT * REPLACE (CASE WHEN pipeline = 'Success' THEN '999888' ELSE pipeline END AS pipeline) FROM shown)"
_COUNTS = ", ".join(f"""count(*) FILTER (WHERE pipeline = '{p}') AS "{p}\"""" for p in _LABELS)


@query("w15_pipeline_distribution_by_agent", f"""
SELECT case_owner AS agent, {_COUNTS}, count(*) AS total FROM {_ODD} GROUP BY 1""")
def _(spark, sf):
    return w.pipeline_distribution_by_agent(_odd(spark, sf), fx.TICKETS_AS_OF, range_="all", wide=True)


@query("w15_pipeline_distribution_by_agent_long", """
SELECT case_owner AS agent, pipeline, count(*) AS tickets FROM shown GROUP BY 1, 2""")
def _(spark, sf):
    return w.pipeline_distribution_by_agent(_t(spark, sf), fx.TICKETS_AS_OF, range_="all", wide=False)


_MEDIANS = ", ".join(
    f"""round(median(first_response_hours) FILTER (WHERE pipeline = '{p}') + 2.3e-10::DOUBLE, 6) AS "{p}\""""
    for p in _LABELS)


@query("w16_pipeline_response_time_heatmap", f"""
SELECT case_owner AS agent, {_MEDIANS} FROM {_ODD} WHERE first_response_hours > 0 GROUP BY 1""")
def _(spark, sf):
    return w.pipeline_response_time_heatmap(_odd(spark, sf), fx.TICKETS_AS_OF, range_="all", wide=True)


@query("w16_pipeline_response_time_heatmap_long", """
SELECT case_owner AS agent, pipeline, median(first_response_hours) AS median_hours FROM shown
WHERE first_response_hours > 0 GROUP BY 1, 2""", "median_hours")
def _(spark, sf):
    return w.pipeline_response_time_heatmap(_t(spark, sf), fx.TICKETS_AS_OF, range_="all", wide=False)


@query("w17_historic_weekly_volume", f"""
SELECT period, tickets, {_ISO} AS label FROM (SELECT {_MON_T} AS period, count(*) AS tickets FROM shown GROUP BY 1)""")
def _(spark, sf):
    return w.historic_weekly_volume(_t(spark, sf), fx.TICKETS_AS_OF, range_="all")


@query("w17_historic_weekly_volume_daily", f"""
SELECT period, tickets, {_ISO} AS label FROM (SELECT CAST(create_ts_local AS DATE) AS period, count(*) AS tickets
  FROM shown WHERE isodow(create_ts_local) < 6 AND {_T['7d']} GROUP BY 1)""")
def _(spark, sf):
    return w.historic_weekly_volume(_t(spark, sf), fx.TICKETS_AS_OF, range_="7d")


@query("j7_daily_satisfaction_join", """
SELECT c.*, coalesce(r.satisfaction_pct, 0) AS satisfaction_pct
FROM (SELECT date, count(*) AS chats FROM first_chats GROUP BY 1) c LEFT JOIN ratings r ON r.date = c.date""",
       "satisfaction_pct")
def _(spark, sf):
    daily = joins.dedup(fx.chats(spark, sf), "chat_id", ["load_seq"]).groupBy("date").agg(F.count("*").alias("chats"))
    return w.join_daily_satisfaction(daily, _ratings(spark, sf).select("date", "satisfaction_pct"))
