"""Row filters over the derived tables."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import functions as F

from caseload.operators import filters, search
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.plans.oracle_views import MON, TUE
from caseload.session import scratch_path

_KEEP = ["ticket_id", "create_ts_utc"]
_ROWS = "SELECT ticket_id, create_ts_utc FROM tickets WHERE "


def _tickets(spark, sf):
    return fx.tickets(spark, sf)


@query("f1_filter_range", _ROWS + "create_ts_utc BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-03-01 12:00'")
def _(spark, sf):
    return filters.filter_range(
        _tickets(spark, sf), dt.datetime(1996, 3, 1), dt.datetime(1998, 3, 1, 12)).select(*_KEEP)


@query("f1_range_counts", """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE create_ts_utc
  BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-03-01 12:00') AS rows_after FROM tickets""")
def _(spark, sf):
    return filters.range_counts(_tickets(spark, sf), dt.datetime(1996, 3, 1), dt.datetime(1998, 3, 1, 12))


@query("f2_drop_spam", "SELECT ticket_id, pipeline FROM tickets WHERE pipeline IS DISTINCT FROM 'SPAM Tickets'")
def _(spark, sf):
    return filters.drop_spam(_tickets(spark, sf)).select("ticket_id", "pipeline")


@query("f3_support_team", """
SELECT ticket_id, case_owner FROM tickets WHERE case_owner IN ('Bhushan', 'Girly', 'Nova', 'Francis')""")
def _(spark, sf):
    return filters.support_team(_tickets(spark, sf)).select("ticket_id", "case_owner")


_NAMED = {
    "7d": "TIMESTAMP '2001-07-23 04:00'", "8w": "TIMESTAMP '2001-06-06 04:00'",
    "52w": "TIMESTAMP '2000-08-02 04:00'", "13w": "TIMESTAMP '2000-10-01 04:00'",
    "ytd": "TIMESTAMP '2001-01-01 05:00'", "all": None,
}


@query("f4_filter_named_range", " UNION ALL ".join(
    f"SELECT '{name}' AS range_name, count(*) AS rows, min(create_ts_utc) AS first_ts, max(create_ts_utc) AS last_ts "
    f"FROM tickets" + (f" WHERE create_ts_utc BETWEEN {low} AND TIMESTAMP '2001-08-02'" if low else "")
    for name, low in _NAMED.items()))
def _(spark, sf):
    tickets, out = _tickets(spark, sf), None
    for name in _NAMED:
        part = filters.filter_named_range(tickets, name, "tickets", fx.TICKETS_AS_OF).agg(
            F.lit(name).alias("range_name"), F.count("*").alias("rows"),
            F.min("create_ts_utc").alias("first_ts"), F.max("create_ts_utc").alias("last_ts"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f5_period_filter", _ROWS + """
  create_ts_local >= (SELECT max(create_ts_local) FROM tickets) - INTERVAL 84 DAY""")
def _(spark, sf):
    return filters.period_filter(_tickets(spark, sf), "12_weeks").select(*_KEEP)


@query("f5_period_filter_custom", _ROWS + """
  create_ts_local >= TIMESTAMP '1999-02-01' AND create_ts_local < TIMESTAMP '1999-05-01'""")
def _(spark, sf):
    return filters.period_filter(
        _tickets(spark, sf), "custom", dt.date(1999, 2, 1), dt.date(1999, 4, 30)).select(*_KEEP)


@query("f6_period_filter_now", _ROWS + "create_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 56 DAY")
def _(spark, sf):
    return filters.period_filter_now(_tickets(spark, sf), "8_weeks", fx.TICKETS_AS_OF).select(*_KEEP)


@query("f7_filter_calendar", """
SELECT 'week' AS kind, ticket_id FROM tickets WHERE create_ts_utc BETWEEN TIMESTAMP '1998-10-26 05:00'
  AND TIMESTAMP '1998-11-02 04:59:59'
UNION ALL SELECT 'day', ticket_id FROM tickets WHERE create_ts_utc BETWEEN TIMESTAMP '1998-07-01 04:00'
  AND TIMESTAMP '1998-07-02 03:59:59'
UNION ALL SELECT 'custom', ticket_id FROM tickets WHERE create_ts_utc BETWEEN TIMESTAMP '1998-03-01 05:00'
  AND TIMESTAMP '1998-05-01 03:59:59'""")
def _(spark, sf):
    tickets = _tickets(spark, sf)
    spans = [("week", dt.date(1998, 10, 26), None), ("day", dt.date(1998, 7, 1), None),
             ("custom", dt.date(1998, 3, 1), dt.date(1998, 4, 30))]
    parts = [filters.filter_calendar(tickets, kind, a, b).select(F.lit(kind).alias("kind"), "ticket_id")
             for kind, a, b in spans]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_REL = {
    "last 35 days": ("2001-06-28", "2001-08-02"), "this month": ("2001-08-01", "2001-08-02"),
    "last month": ("2001-07-01", "2001-07-31"), "this quarter": ("2001-07-01", "2001-08-02"),
    "this year": ("2001-01-01", "2001-08-02"),
}


@query("f8_filter_relative", " UNION ALL ".join(
    f"SELECT '{name}' AS period, count(*) AS rows, max(ticket_id) AS last_id FROM tickets "
    f"WHERE create_ts_utc BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for name, (a, b) in _REL.items()))
def _(spark, sf):
    tickets, out = _tickets(spark, sf), None
    for name in _REL:
        part = filters.filter_relative(tickets, name, fx.TICKETS_AS_OF.date()).agg(
            F.lit(name).alias("period"), F.count("*").alias("rows"), F.max("ticket_id").alias("last_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f9_rolling_window", _ROWS + "create_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY")
def _(spark, sf):
    return filters.rolling_window(_tickets(spark, sf), 365, fx.TICKETS_AS_OF).select(*_KEEP)


@query("f10_in_list", """
SELECT ticket_id, case_owner, pipeline FROM tickets WHERE case_owner IN ('Nova', 'Girly')
  AND coalesce(pipeline, '') NOT IN ('Success', 'Dev Tickets')""")
def _(spark, sf):
    mine = filters.in_list(_tickets(spark, sf), "case_owner", ["Nova", "Girly"])
    return filters.in_list(mine, "pipeline", ["Success", "Dev Tickets"], negate=True).select(
        "ticket_id", "case_owner", "pipeline")


@query("f11_valid_hours", """
SELECT ticket_id, first_response_hours FROM tickets WHERE first_response_hours > 0""", "first_response_hours")
def _(spark, sf):
    return filters.valid_hours(_tickets(spark, sf)).select("ticket_id", "first_response_hours")


@query("f12_view", """
SELECT ticket_id, is_weekend, pipeline FROM tickets
WHERE NOT is_weekend AND rtrim(pipeline) IS DISTINCT FROM 'Live Chat'""")
def _(spark, sf):
    return filters.view(_tickets(spark, sf), "weekday", exclude_live_chat=True).select(
        "ticket_id", "is_weekend", "pipeline")


@query("f13_bucket", f"""
SELECT CAST(create_ts_local AS DATE) AS day, {MON.format('create_ts_local')} AS week_mon,
  {TUE.format('create_ts_local')} AS week_tue, CAST(date_trunc('month', create_ts_local) AS DATE) AS month,
  CAST(date_trunc('quarter', create_ts_local) AS DATE) AS quarter, count(*) AS tickets
FROM tickets GROUP BY ALL""")
def _(spark, sf):
    out = _tickets(spark, sf)
    for grain in ("day", "week_mon", "week_tue", "month", "quarter"):
        out = filters.bucketed(out, "create_ts_local", grain, grain)
    return out.groupBy("day", "week_mon", "week_tue", "month", "quarter").agg(F.count("*").alias("tickets"))


@query("f14_search", """
SELECT ticket_id, subject, ticket_owner, pipeline FROM tickets
WHERE lower(subject) LIKE '%urgent p%' OR lower(ticket_owner) LIKE '%urgent p%' OR lower(pipeline) LIKE '%urgent p%'
ORDER BY ticket_id LIMIT 25""")
def _(spark, sf):
    rows = _tickets(spark, sf).select("ticket_id", "subject", "ticket_owner", "pipeline")
    return filters.search(rows, "URGENT P", 25)


@query("f14_search_messages", """
SELECT conv_id, turn, author_type, text FROM messages WHERE lower(text) LIKE '%the%' OR author_type LIKE '%the%'
ORDER BY conv_id, turn LIMIT 40""")
def _(spark, sf):
    rows = fx.messages(spark, sf).select(
        F.struct("conv_id", "turn").alias("key"), "conv_id", "turn", "author_type", "text")
    return filters.search(rows, "The", 40, key="key").drop("key")


@lru_cache(maxsize=4)
def _index(spark, sf):
    """Postings of the tickets by month, built once a session; one month is built again."""
    rows = _tickets(spark, sf).select("ticket_id", "subject", "ticket_owner", "pipeline", F.trunc(F.to_date("create_ts_utc"), "month").alias("month"))
    index = search.SearchIndex(spark, scratch_path(spark, "postings"), month="month")
    index.build(rows)
    index.build(rows.where("month = date '1996-03-01'"))
    return index


def _found(spark, sf, text, limit):
    rows = _tickets(spark, sf).select("ticket_id", "subject", "ticket_owner", "pipeline")
    return _index(spark, sf).search(rows, text, limit)


def _scan(text: str, limit: int) -> str:
    tests = " OR ".join(f"contains(lower({c}), '{text.lower()}')" for c in ("subject", "ticket_owner", "pipeline"))
    return f"SELECT ticket_id, subject, ticket_owner, pipeline FROM tickets WHERE {tests} ORDER BY ticket_id LIMIT {limit}"


for _text, _limit in {"URGENT P": 25, "Girly": 1_000_000, "v": 60, "y ": 40, "no such text": 10}.items():

    @query(f"f14_search_index_{_text.strip().replace(' ', '_').lower()}", _scan(_text, _limit))
    def _(spark, sf, text=_text, limit=_limit):
        return _found(spark, sf, text, limit)
