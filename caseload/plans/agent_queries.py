"""Agent comparison over the derived tickets."""

from __future__ import annotations

from caseload.operators import agent_reports as reports
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.plans.oracle_views import TUE
from caseload.plans.ticket_queries import breakdown_text

AGENT = "Nova"
_TEAM = "('Nova', 'Girly', 'Francis', 'Bhushan')"
_AGENTS = ("Nova", "Girly", "Francis", "Bhushan")
_WEEK = TUE.format("create_ts_local")
_LIVE = "rtrim(pipeline) IS NOT DISTINCT FROM 'Live Chat'"
_HOURS = "mean_hours median_hours std_hours"

_G1 = f"""
SELECT agent, total_tickets, non_live_chat_tickets, mean_hours, median_hours, std_hours, min_hours, max_hours,
  q25_hours, q75_hours, CAST(round(CAST(total_tickets * 100.0 / sum(total_tickets) OVER () AS DECIMAL(38,12)), 1) AS DOUBLE) AS share_pct, pipelines
FROM (SELECT case_owner AS agent, count(*) AS total_tickets, count(*) FILTER (WHERE NOT ({_LIVE})) AS non_live_chat_tickets,
    avg(v) AS mean_hours, median(v) AS median_hours, stddev_samp(v) AS std_hours, min(v) AS min_hours,
    max(v) AS max_hours, quantile_cont(v, 0.25) AS q25_hours, quantile_cont(v, 0.75) AS q75_hours, count(v) AS n
  FROM (SELECT *, CASE WHEN NOT ({_LIVE}) THEN first_response_hours END AS v FROM comparison
    WHERE NOT is_weekend AND case_owner IN {_TEAM}) GROUP BY 1) g
JOIN (SELECT case_owner, string_agg(pipeline || '=' || n, '; ' ORDER BY n DESC, pipeline) AS pipelines
  FROM (SELECT case_owner, pipeline, count(*) AS n FROM comparison WHERE NOT is_weekend GROUP BY 1, 2)
  GROUP BY 1) p ON p.case_owner = agent
WHERE n > 0"""


@query("g1_agent_stats", _G1, _HOURS + " min_hours max_hours q25_hours q75_hours share_pct")
def _(spark, sf):
    return breakdown_text(reports.agent_stats(fx.comparison(spark, sf)))


_G2 = f"""
SELECT {_WEEK} AS week, {', '.join(f"count(*) FILTER (WHERE case_owner = '{a}') AS {a}" for a in _AGENTS)},
  count(*) FILTER (WHERE case_owner IN {_TEAM}) AS total
FROM comparison GROUP BY 1"""


@query("g2_weekly_agent_volume", _G2)
def _(spark, sf):
    return reports.weekly_agent_volume(fx.comparison(spark, sf))


_MEDIANS = ", ".join(
    f"median(first_response_hours) FILTER (WHERE case_owner = '{a}' AND NOT is_weekend AND NOT ({_LIVE})) AS {a}"
    for a in _AGENTS)
_G3 = f"SELECT {_WEEK} AS week, {_MEDIANS} FROM comparison GROUP BY 1"


@query("g3_weekly_agent_response", _G3, " ".join(_AGENTS))
def _(spark, sf):
    return reports.weekly_agent_response(fx.comparison(spark, sf))


def _trend(grid: str) -> str:
    parts = " UNION ALL ".join(f"SELECT week, '{a}' AS agent, CAST({a} AS DOUBLE) AS value FROM g" for a in _AGENTS)
    return f"""
WITH g AS ({grid}), l AS ({parts}),
x AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY week) - 1 AS x FROM l)
SELECT week, agent, value, regr_slope(value, x) OVER (PARTITION BY agent) * x
  + regr_intercept(value, x) OVER (PARTITION BY agent) AS trend FROM x"""


@query("g4_agent_trends_volume", _trend(_G2), "value trend")
def _(spark, sf):
    return reports.agent_trends(reports.weekly_agent_volume(fx.comparison(spark, sf)))


@query("g4_agent_trends_response", _trend(_G3), "value trend")
def _(spark, sf):
    return reports.agent_trends(reports.weekly_agent_response(fx.comparison(spark, sf)))


_TOP = f"""
WITH top AS (SELECT pipeline, count(*) AS n FROM comparison WHERE pipeline IS NOT NULL GROUP BY 1
  ORDER BY n DESC, pipeline LIMIT 6),
who AS (SELECT case_owner, count(*) AS n FROM comparison WHERE case_owner IN {_TEAM} GROUP BY 1)"""


@query("g5_pipeline_distribution", _TOP + """
SELECT who.case_owner AS agent, top.pipeline,
  (SELECT count(*) FROM comparison c WHERE c.case_owner = who.case_owner AND c.pipeline = top.pipeline) AS tickets,
  (SELECT count(*) FROM comparison c WHERE c.case_owner = who.case_owner AND c.pipeline = top.pipeline)
    * 100.0 / who.n AS share_pct
FROM who, top""", "share_pct")
def _(spark, sf):
    return reports.pipeline_distribution(fx.comparison(spark, sf))


@query("g6_pipeline_performance", _TOP + f"""
SELECT who.case_owner AS agent, top.pipeline,
  CASE WHEN rtrim(top.pipeline) = 'Live Chat' THEN 0.008::DOUBLE ELSE s.m END AS median_hours,
  coalesce(CASE WHEN rtrim(top.pipeline) = 'Live Chat' THEN s.a ELSE s.n END, 0) AS responses
FROM who, top LEFT JOIN (SELECT case_owner, pipeline, median(first_response_hours) AS m,
    count(first_response_hours) AS n, count(*) AS a FROM comparison GROUP BY 1, 2) s
  ON s.case_owner = who.case_owner AND s.pipeline = top.pipeline""".replace(
    "FROM who, top LEFT", "FROM who CROSS JOIN top LEFT"), "median_hours")
def _(spark, sf):
    return reports.pipeline_performance(fx.comparison(spark, sf))


@query("g7_pipeline_summary", """
SELECT pipeline, count(*) AS total_tickets, count(*) * 100.0 / (SELECT count(*) FROM comparison) AS share_pct,
  CASE WHEN rtrim(pipeline) = 'Live Chat' THEN 0.008::DOUBLE ELSE avg(first_response_hours) END AS mean_hours,
  CASE WHEN rtrim(pipeline) = 'Live Chat' THEN 0.008::DOUBLE ELSE median(first_response_hours) END AS median_hours
FROM comparison WHERE pipeline IS NOT NULL GROUP BY 1 ORDER BY total_tickets DESC, pipeline LIMIT 6""",
       "share_pct mean_hours median_hours")
def _(spark, sf):
    return reports.pipeline_summary(fx.comparison(spark, sf))


@query("g8_leaders", f"""
WITH s AS ({_G1})
SELECT (SELECT agent FROM s ORDER BY total_tickets DESC, agent LIMIT 1) AS volume_leader,
  (SELECT max(total_tickets) FROM s) AS volume_tickets,
  (SELECT share_pct FROM s ORDER BY total_tickets DESC, agent LIMIT 1) AS volume_share_pct,
  (SELECT agent FROM s ORDER BY median_hours, agent LIMIT 1) AS speed_leader,
  (SELECT min(median_hours) FROM s) AS speed_median_hours,
  (SELECT min(median_hours) * 60 FROM s) AS speed_median_minutes,
  (SELECT agent FROM s ORDER BY std_hours, agent LIMIT 1) AS consistency_leader,
  (SELECT min(std_hours) FROM s) AS consistency_std_hours""",
       "volume_share_pct speed_median_hours speed_median_minutes consistency_std_hours")
def _(spark, sf):
    return reports.leaders(reports.agent_stats(fx.comparison(spark, sf)))


@query("g9_individual_vs_team", f"""
SELECT *, agent_volume * 100.0 / team_volume AS volume_share_pct,
  abs(team_mean_hours - agent_mean_hours) AS mean_difference,
  CASE WHEN agent_mean_hours < team_mean_hours THEN 'faster' ELSE 'slower' END AS mean_verdict,
  abs(team_median_hours - agent_median_hours) AS median_difference,
  CASE WHEN agent_median_hours < team_median_hours THEN 'faster' ELSE 'slower' END AS median_verdict
FROM (SELECT '{AGENT}' AS agent,
  count(*) FILTER (WHERE case_owner = '{AGENT}' AND NOT live) AS agent_tickets,
  avg(v) FILTER (WHERE case_owner = '{AGENT}') AS agent_mean_hours,
  median(v) FILTER (WHERE case_owner = '{AGENT}') AS agent_median_hours,
  count(*) FILTER (WHERE case_owner = '{AGENT}') AS agent_volume,
  count(*) FILTER (WHERE NOT live) AS team_tickets, avg(v) AS team_mean_hours, median(v) AS team_median_hours,
  count(*) AS team_volume
  FROM (SELECT case_owner, {_LIVE} AS live, CASE WHEN NOT ({_LIVE}) THEN first_response_hours END AS v
    FROM comparison WHERE NOT is_weekend))""",
       "agent_mean_hours agent_median_hours team_mean_hours team_median_hours volume_share_pct mean_difference "
       "median_difference")
def _(spark, sf):
    return reports.individual_vs_team(fx.comparison(spark, sf), AGENT)


@query("g10_team_breakdown", f"""
SELECT case_owner AS agent, count(first_response_hours) AS responses,
  coalesce(CAST(round(CAST(avg(first_response_hours) AS DECIMAL(38,12)), 3) AS DOUBLE), 0) AS mean_hours,
  coalesce(CAST(round(CAST(median(first_response_hours) AS DECIMAL(38,12)), 3) AS DOUBLE), 0) AS median_hours,
  coalesce(CAST(round(CAST(stddev_samp(first_response_hours) AS DECIMAL(38,12)), 3) AS DOUBLE), 0) AS std_hours
FROM comparison WHERE NOT is_weekend AND NOT ({_LIVE}) AND case_owner IS NOT NULL GROUP BY 1""", _HOURS)
def _(spark, sf):
    return reports.team_breakdown(fx.comparison(spark, sf))


@query("g11_weekly_individual", f"""
SELECT {_WEEK} AS week,
  coalesce(median(first_response_hours) FILTER (WHERE case_owner = '{AGENT}'), 0) AS agent_median,
  count(*) FILTER (WHERE case_owner = '{AGENT}') AS agent_tickets,
  coalesce(median(first_response_hours), 0) AS team_median, count(*) AS total_tickets
FROM comparison WHERE NOT is_weekend AND NOT ({_LIVE}) GROUP BY 1""", "agent_median team_median")
def _(spark, sf):
    return reports.weekly_individual(fx.comparison(spark, sf), AGENT)
