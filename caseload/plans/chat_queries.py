"""Chat and cross-channel reports over the derived chats."""

from __future__ import annotations

import datetime as dt

from caseload.operators import chat_reports as reports
from caseload.operators import cross_channel
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.plans.oracle_views import TUE
from caseload.sources import payloads

_WEEK = TUE.format("created_ts_local")
_SAT = ("coalesce(count(*) FILTER (WHERE rating_value = 5) * 100.0 / nullif(count(*) FILTER (WHERE has_rating), 0), 0) "
        "AS satisfaction_pct")


@query("c1_chat_volume", f"""
WITH d AS (SELECT date, count(*) AS chats FROM chats GROUP BY 1),
s AS (SELECT count(*) AS total_days, avg(chats) AS mean_daily, max(chats) AS peak_chats,
    (SELECT date FROM d ORDER BY chats DESC, date LIMIT 1) AS peak_day FROM d)
SELECT * FROM (SELECT 'day' AS grain, date AS period, chats FROM d UNION ALL
  SELECT 'week', {TUE.format('CAST(date AS TIMESTAMP)')}, CAST(sum(chats) AS BIGINT) FROM d GROUP BY 2), s""", "mean_daily")
def _(spark, sf):
    return reports.chat_volume(fx.chats(spark, sf))


@query("c2_chat_hourly", """
WITH h AS (SELECT hour, count(*) AS chats FROM chats GROUP BY 1)
SELECT hour, chats, (SELECT hour FROM h ORDER BY chats DESC, hour LIMIT 1) AS peak_hour,
  (SELECT sum(chats) FILTER (WHERE hour BETWEEN 9 AND 17) / sum(chats) FROM h) AS business_hours_ratio
FROM h""", "business_hours_ratio")
def _(spark, sf):
    return reports.chat_hourly(fx.chats(spark, sf))


@query("c3_chat_trend", """
WITH d AS (SELECT date, count(*) AS chats, row_number() OVER (ORDER BY date) - 1 AS x FROM chats GROUP BY 1)
SELECT 'ok' AS trend, s AS trend_slope,
  CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  (SELECT (arg_max(chats, date) - arg_min(chats, date)) * 100.0 / arg_min(chats, date) FROM d) AS growth_rate
FROM (SELECT regr_slope(CAST(chats AS DOUBLE), x) AS s FROM d)""", "trend_slope growth_rate")
def _(spark, sf):
    return reports.chat_trend(fx.chats(spark, sf))


@query("c4_bot_metrics", """
SELECT primary_agent AS bot, display_agent, count(*) AS chats, avg(duration_minutes) AS mean_duration,
  count(*) FILTER (WHERE has_rating) AS rated_chats, avg(rating_value) AS mean_rating,
  (SELECT count(*) FROM chats WHERE agent_type = 'bot') AS bot_chats,
  (SELECT count(*) FILTER (WHERE agent_type = 'bot') * 100.0 / count(*) FROM chats) AS bot_share_pct,
  (SELECT avg(duration_minutes) FROM chats WHERE agent_type = 'bot') AS bot_mean_duration
FROM chats WHERE agent_type = 'bot' GROUP BY 1, 2""", "mean_duration mean_rating bot_share_pct bot_mean_duration")
def _(spark, sf):
    return reports.bot_metrics(fx.chats(spark, sf))


_SHOWN = ("CASE agent WHEN 'Shan' THEN 'Bhushan' WHEN 'Chris' THEN 'Francis' WHEN 'Nora' THEN 'Nova' "
          "WHEN 'Gillie' THEN 'Girly' ELSE agent END")


@query("c5_human_metrics", f"""
SELECT agent, {_SHOWN} AS display_agent, count(*) AS chats, avg(duration_minutes) AS mean_duration,
  count(*) FILTER (WHERE has_rating) AS rated_chats, avg(rating_value) AS mean_rating,
  count(*) FILTER (WHERE bot_transfer) AS transfers_received,
  (SELECT count(*) FROM chats WHERE agent_type = 'human') AS human_chats,
  (SELECT count(*) FILTER (WHERE agent_type = 'human') * 100.0 / count(*) FROM chats) AS human_share_pct,
  (SELECT avg(duration_minutes) FROM chats WHERE agent_type = 'human') AS human_mean_duration
FROM credited GROUP BY 1""", "mean_duration mean_rating human_share_pct human_mean_duration")
def _(spark, sf):
    return reports.human_metrics(fx.chats(spark, sf))


@query("c6_agent_type_performance", f"""
SELECT agent_type, count(*) AS chats, avg(duration_minutes) AS mean_duration,
  avg(first_response_seconds) AS mean_first_response, {_SAT}
FROM chats WHERE agent_type IN ('bot', 'human') GROUP BY 1""", "mean_duration mean_first_response satisfaction_pct")
def _(spark, sf):
    return reports.agent_type_performance(fx.chats(spark, sf))


_RATED = """count(*) AS rated, count(*) FILTER (WHERE rating_value = 5) AS good,
  count(*) FILTER (WHERE rating_value = 1) AS bad,
  count(*) FILTER (WHERE rating_value = 5) * 100.0 / count(*) AS satisfaction_pct"""


@query("c7_satisfaction", f"""
SELECT 'overall' AS level, 'all' AS name, {_RATED} FROM chats WHERE has_rating
UNION ALL SELECT 'bot', primary_agent, {_RATED} FROM chats WHERE has_rating AND agent_type = 'bot' GROUP BY 2
UNION ALL SELECT 'human', agent, {_RATED} FROM credited WHERE has_rating GROUP BY 2
UNION ALL SELECT 'rating', printf('%.1f', rating_value), {_RATED} FROM chats WHERE has_rating GROUP BY 2""",
       "satisfaction_pct")
def _(spark, sf):
    return reports.satisfaction(fx.chats(spark, sf))


@query("c8_transfers", """
WITH d AS (SELECT date, count(*) AS chats, count(*) FILTER (WHERE bot_transfer) AS transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate FROM chats GROUP BY 1)
SELECT d.*, total_transfers, total_transfers * 100.0 / n AS total_transfer_rate,
  bots - total_transfers AS bot_only_chats, (bots - total_transfers) * 100.0 / n AS bot_only_rate,
  (SELECT avg(transfer_rate) FROM d) AS mean_daily_rate
FROM d, (SELECT count(*) FILTER (WHERE bot_transfer) AS total_transfers, count(*) AS n,
  count(*) FILTER (WHERE agent_type = 'bot') AS bots FROM chats)""",
       "transfer_rate total_transfer_rate bot_only_rate mean_daily_rate")
def _(spark, sf):
    return reports.transfers(fx.chats(spark, sf))


@query("c9_chat_response", """
SELECT avg(first_response_seconds) AS mean_first_response, avg(avg_response_seconds) AS mean_response,
  avg(first_response_seconds) FILTER (WHERE agent_type = 'bot') AS bot_first_response,
  avg(first_response_seconds) FILTER (WHERE agent_type = 'human') AS human_first_response FROM chats""",
       "mean_first_response mean_response bot_first_response human_first_response")
def _(spark, sf):
    return reports.chat_response(fx.chats(spark, sf))


@query("c10_geography", """
WITH g AS (SELECT country, count(*) AS chats FROM chats WHERE country IS NOT NULL GROUP BY 1)
SELECT country, chats, (SELECT count(*) FROM g) AS total_countries,
  (SELECT country FROM g ORDER BY chats DESC, country LIMIT 1) AS top_country
FROM g ORDER BY chats DESC, country LIMIT 10""")
def _(spark, sf):
    return reports.geography(fx.chats(spark, sf))


# The outer-join form of the weekly counts; Spark computes them in one conditional aggregation.
_J4 = f"""
WITH a AS (SELECT {_WEEK} AS week, count(*) AS n FROM chats GROUP BY 1),
b AS (SELECT {_WEEK} AS week, count(*) AS n FROM chats WHERE agent_type = 'bot' GROUP BY 1),
h AS (SELECT {_WEEK} AS week, count(*) AS n FROM chats WHERE agent_type = 'human' GROUP BY 1),
t AS (SELECT {_WEEK} AS week, count(*) AS n FROM chats WHERE bot_transfer GROUP BY 1)
SELECT coalesce(a.week, b.week, h.week) AS week, coalesce(a.n, 0) AS all_chats, coalesce(b.n, 0) AS bot_chats,
  coalesce(h.n, 0) AS human_chats, coalesce(t.n, 0) AS transfers,
  coalesce(a.n, 0) = coalesce(b.n, 0) + coalesce(h.n, 0) AS counts_agree
FROM a FULL JOIN b ON b.week = a.week FULL JOIN h ON h.week = coalesce(a.week, b.week)
LEFT JOIN t ON t.week = coalesce(a.week, b.week, h.week)"""


@query("j4_weekly_counts_joined", _J4)
def _(spark, sf):
    return reports.weekly_counts_joined(fx.chats(spark, sf))


@query("c11_weekly_chat_volume", f"""
SELECT *, transfers * 100.0 / all_chats AS transfer_rate FROM ({_J4}) ORDER BY week DESC LIMIT 12""".replace(
    _J4, "\n" + _J4), "transfer_rate")
def _(spark, sf):
    return reports.weekly_chat_volume(fx.chats(spark, sf))


@query("c12_weekly_satisfaction", f"""
SELECT week, agent_type, mean_rating, ratings, (mean_rating - 1) * 25 AS satisfaction_pct
FROM (SELECT {_WEEK} AS week, agent_type, avg(rating_value) AS mean_rating, count(*) AS ratings FROM chats
  WHERE has_rating GROUP BY 1, 2)
WHERE week IN (SELECT DISTINCT {_WEEK} AS w FROM chats WHERE has_rating ORDER BY w DESC LIMIT 12)""",
       "mean_rating satisfaction_pct")
def _(spark, sf):
    return reports.weekly_satisfaction(fx.chats(spark, sf))


@query("c13_agent_chat_stats", f"""
SELECT 'bot' AS kind, display_agent AS agent, display_agent, count(*) AS chats,
  avg(duration_minutes) AS mean_duration, {_SAT}
FROM chats WHERE display_agent IN (SELECT display_agent FROM chats WHERE agent_type = 'bot') GROUP BY 2
UNION ALL SELECT 'human', agent, {_SHOWN}, count(*), avg(duration_minutes), {_SAT} FROM credited GROUP BY 2""",
       "mean_duration satisfaction_pct")
def _(spark, sf):
    return reports.agent_chat_stats(fx.chats(spark, sf))


@query("c14_bot_comparison", """
SELECT display_agent AS bot, count(*) AS chats, coalesce(avg(rating_value) * 20, 0) AS satisfaction_pct,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate, avg(duration_minutes) AS mean_duration
FROM chats WHERE agent_type = 'bot' GROUP BY 1""", "satisfaction_pct transfer_rate mean_duration")
def _(spark, sf):
    return reports.bot_comparison(fx.chats(spark, sf))


@query("c15_daily_chat_trends", """
SELECT date, count(*) AS chats, coalesce(avg(rating_value) * 20, 0) AS satisfaction_pct,
  count(*) FILTER (WHERE bot_transfer) AS transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate
FROM chats GROUP BY 1""", "satisfaction_pct transfer_rate")
def _(spark, sf):
    return reports.daily_chat_trends(fx.chats(spark, sf))


_OVERVIEW = f"""
SELECT count(*) AS total_chats, count(*) / count(DISTINCT date) AS mean_daily_chats,
  count(*) FILTER (WHERE agent_type = 'bot') * 100.0 / count(*) AS bot_share_pct,
  count(*) FILTER (WHERE agent_type = 'human') * 100.0 / count(*) AS human_share_pct,
  count(*) FILTER (WHERE bot_transfer) AS total_transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate,
  count(*) FILTER (WHERE rating_value = 5) * 100.0 / count(*) FILTER (WHERE has_rating) AS satisfaction_pct,
  (count(*) FILTER (WHERE agent_type = 'bot') - count(*) FILTER (WHERE bot_transfer)) * 100.0 / count(*)
    AS bot_resolution_pct,
  (SELECT count(DISTINCT {_SHOWN}) FROM credited) AS active_agents
FROM chats"""
_OVERVIEW_DOUBLES = ("mean_daily_chats bot_share_pct human_share_pct transfer_rate satisfaction_pct "
                     "bot_resolution_pct")


@query("c16_chat_overview", _OVERVIEW, _OVERVIEW_DOUBLES)
def _(spark, sf):
    return reports.chat_overview(fx.chats(spark, sf))


@query("c17_agent_performance_table", f"""
SELECT primary_agent AS agent, display_agent, count(*) AS chats, avg(duration_minutes) AS mean_duration,
  'Bot' AS type, coalesce(avg(rating_value) * 20, 0) AS satisfaction_pct
FROM chats WHERE agent_type = 'bot' GROUP BY 1, 2
UNION ALL SELECT agent, {_SHOWN}, count(*), avg(duration_minutes), 'Human', coalesce(avg(rating_value) * 20, 0)
FROM credited GROUP BY 1""", "mean_duration satisfaction_pct")
def _(spark, sf):
    return reports.agent_performance_table(fx.chats(spark, sf))


_RANGE = ("created_ts_utc BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND TIMESTAMP '2024-01-31'")


@query("c18_chat_cards", f"""
SELECT count(*) AS total_chats, count(*) / 14 AS chats_per_day, count(*) FILTER (WHERE bot_transfer) AS transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate,
  count(*) FILTER (WHERE NOT bot_transfer) * 100.0 / count(*) AS bot_resolution_pct,
  (SELECT sum(good) * 100.0 / sum(total) FROM ratings
    WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30') AS satisfaction_pct
FROM chats WHERE {_RANGE}""", "chats_per_day transfer_rate bot_resolution_pct satisfaction_pct")
def _(spark, sf):
    scores = payloads.explode_ratings(fx.ratings_map(spark, sf))
    return reports.chat_cards(fx.chats(spark, sf), fx.CHATS_AS_OF, 14, scores)


@query("c18_chat_cards_own_ratings", f"""
SELECT count(*) AS total_chats, count(*) / 14 AS chats_per_day, count(*) FILTER (WHERE bot_transfer) AS transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate,
  count(*) FILTER (WHERE NOT bot_transfer) * 100.0 / count(*) AS bot_resolution_pct, {_SAT}
FROM chats WHERE {_RANGE}""", "chats_per_day transfer_rate bot_resolution_pct satisfaction_pct")
def _(spark, sf):
    return reports.chat_cards(fx.chats(spark, sf), fx.CHATS_AS_OF, 14)


@query("c19_chat_keyword_metrics", """
WITH k AS (SELECT *, CASE WHEN regexp_matches(lower(primary_agent), 'bot|ai|wynn|scrape|automated') THEN 'bot'
  ELSE 'human' END AS kind FROM chats),
s AS (SELECT count(*) AS total_chats, count(*) FILTER (WHERE kind = 'bot') AS bot_chats,
  count(*) FILTER (WHERE kind = 'bot') * 100.0 / count(*) AS bot_share_pct,
  count(*) FILTER (WHERE kind = 'human') AS human_chats,
  count(*) FILTER (WHERE kind = 'human') * 100.0 / count(*) AS human_share_pct,
  count(*) FILTER (WHERE kind = 'bot' AND rate_raw = 'rated good') * 100.0
    / count(*) FILTER (WHERE kind = 'bot' AND rate_raw IN ('rated good', 'rated bad')) AS bot_satisfaction_pct FROM k)
SELECT * FROM (SELECT primary_agent AS agent, count(*) AS chats FROM k WHERE kind = 'human' GROUP BY 1
  ORDER BY chats DESC, agent LIMIT 5), s""", "bot_share_pct human_share_pct bot_satisfaction_pct")
def _(spark, sf):
    return reports.chat_keyword_metrics(fx.chats(spark, sf))


@query("x1_cross_channel", f"""
SELECT *, CAST(sum(interactions) OVER () AS BIGINT) AS total_interactions,
  interactions * 100.0 / sum(interactions) OVER () AS share_pct, CAST(sum(agents) OVER () AS BIGINT) AS total_agents
FROM (SELECT 'tickets' AS channel, count(*) AS interactions,
    count(DISTINCT case_owner) FILTER (WHERE NOT is_weekend) AS agents FROM desk
  UNION ALL SELECT 'chats', count(*), (SELECT count(DISTINCT {_SHOWN}) FROM credited) FROM chats)""", "share_pct")
def _(spark, sf):
    return cross_channel.cross_channel(fx.desk(spark, sf), fx.chats(spark, sf))


_X2 = "BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2024-01-20'"


@query("x2_combined_report", f"""
WITH d AS (SELECT * FROM desk WHERE create_ts_utc {_X2}),
c AS (SELECT * FROM chats WHERE created_ts_utc {_X2}),
t AS (SELECT count(*) AS total_tickets, count(*) FILTER (WHERE is_weekend) AS weekend_tickets,
  count(*) FILTER (WHERE NOT is_weekend) AS weekday_tickets,
  avg(first_response_hours) FILTER (WHERE is_weekend) AS mean_response_weekend,
  CAST(floor(epoch(max(create_ts_local) - min(create_ts_local)) / 86400) AS BIGINT) + 1 AS span_days,
  count(DISTINCT case_owner) FILTER (WHERE NOT is_weekend) AS agent_count,
  median(first_response_hours) FILTER (WHERE NOT is_weekend AND rtrim(pipeline) <> 'Live Chat')
    AS median_response_weekday FROM d)
SELECT 'tickets' AS channel, *, total_tickets / span_days AS tickets_per_day,
  weekday_tickets / span_days AS weekday_per_day, weekend_tickets / span_days AS weekend_per_day FROM t
UNION ALL BY NAME SELECT 'chats' AS channel, count(*) AS total_chats, count(*) / count(DISTINCT date) AS mean_daily_chats,
  count(*) FILTER (WHERE agent_type = 'bot') * 100.0 / count(*) AS bot_share_pct,
  count(*) FILTER (WHERE agent_type = 'human') * 100.0 / count(*) AS human_share_pct,
  count(*) FILTER (WHERE bot_transfer) AS total_transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate,
  count(*) FILTER (WHERE rating_value = 5) * 100.0 / count(*) FILTER (WHERE has_rating) AS satisfaction_pct,
  (count(*) FILTER (WHERE agent_type = 'bot') - count(*) FILTER (WHERE bot_transfer)) * 100.0 / count(*)
    AS bot_resolution_pct,
  (SELECT count(DISTINCT {_SHOWN}) FROM credited WHERE created_ts_utc {_X2}) AS active_agents
FROM c""", "tickets_per_day weekday_per_day weekend_per_day mean_response_weekend median_response_weekday "
       + _OVERVIEW_DOUBLES)
def _(spark, sf):
    return cross_channel.combined_report(
        fx.desk(spark, sf), fx.chats(spark, sf), dt.datetime(1995, 6, 1), dt.datetime(2024, 1, 20))
