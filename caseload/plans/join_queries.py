"""Lookups, deduplication, review merge and reconciliation over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.operators import joins
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query


@query("j1_lookup_owner", """
SELECT o_orderkey AS ticket_id, coalesce(c_name, CAST(o_custkey + 7 AS VARCHAR)) AS ticket_owner
FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 7""")
def _(spark, sf):
    owners = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    # Seven customer numbers lie beyond the directory and pass through.
    tickets = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS ticket_id", "CAST(o_custkey + 7 AS STRING) AS ticket_owner")
    return joins.lookup_owner(tickets, owners)


@query("j2_lookup_pipeline", """
SELECT o_orderkey AS ticket_id, coalesce(n_name, CAST(o_custkey % 30 AS VARCHAR)) AS pipeline
FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30""")
def _(spark, sf):
    dim = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    tickets = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS ticket_id", "CAST(o_custkey % 30 AS STRING) AS pipeline")
    return joins.lookup_pipeline(tickets, dim)


@query("j3_lookup_agent", """
SELECT event_id AS chat_id, agent_id,
  CASE WHEN n_name IS NOT NULL THEN n_name WHEN agent_id = '5626186ef1d50006d82a02372509ec3e' THEN 'Agent Scrape'
    WHEN agent_id IS NOT NULL THEN 'Unknown' END AS agent_name,
  coalesce(n_regionkey = 0, coalesce(agent_id = '5626186ef1d50006d82a02372509ec3e', false)) AS is_bot
FROM (SELECT event_id, CASE WHEN user_id % 30 < 27 THEN CAST(user_id % 30 AS VARCHAR)
    WHEN user_id % 30 = 27 THEN '5626186ef1d50006d82a02372509ec3e' END AS agent_id FROM events)
LEFT JOIN nation ON agent_id = CAST(n_nationkey AS VARCHAR)""")
def _(spark, sf):
    directory = fx.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS id", "n_name AS name", "if(n_regionkey = 0, 'bot', 'agent') AS type")
    chats = fx.table(spark, sf, "events").selectExpr(
        "event_id AS chat_id",
        "CASE WHEN user_id % 30 < 27 THEN CAST(user_id % 30 AS STRING) "
        "WHEN user_id % 30 = 27 THEN '5626186ef1d50006d82a02372509ec3e' END AS agent_id")
    return joins.lookup_agent(chats, directory)


_QA_SQL = """
SELECT t.ticket_id, t.subject, coalesce(q.overall, '') AS "QA - Overall Performance Rating",
  coalesce(q.systemic, '') AS "QA - 14. Tag for Systemic Review?"
FROM raw_tickets t LEFT JOIN qa q ON q.ticket_id = t.ticket_id AND q.qa_seq = 1"""


@query("j8_integrate_qa", _QA_SQL)
def _(spark, sf):
    main = fx.raw_tickets(spark, sf).select("ticket_id", "subject")
    return joins.integrate_qa(main, fx.qa(spark, sf), "ticket_id", order=["qa_seq"])


@query("j9_dedup", """
SELECT chat_id, load_seq, duration_seconds, display_agent FROM chats WHERE load_seq = 0""", "duration_seconds")
def _(spark, sf):
    return joins.dedup(fx.chats(spark, sf), "chat_id", ["load_seq"]).select(
        "chat_id", "load_seq", "duration_seconds", "display_agent")


@query("j10_explode_agents", """
SELECT chat_id, load_seq, CASE WHEN a = 'gillie' THEN 'Girly' WHEN a = 'nora n' THEN 'Nova'
  WHEN a = 'shan' THEN 'Bhushan' ELSE 'Francis' END AS human_agent
FROM (SELECT chat_id, load_seq, trim(lower(unnest(string_split(human_agents, ',')))) AS a FROM chats
  WHERE human_agents <> '') WHERE a IN ('gillie', 'nora n', 'shan', 'chris')""")
def _(spark, sf):
    return joins.explode_agents(fx.chats(spark, sf)).select("chat_id", "load_seq", "human_agent")


@query("j11_reconcile", """
SELECT (SELECT count(*) FROM store) AS left_rows, (SELECT count(*) FROM delta) AS right_rows,
  (SELECT count(*) FROM store s WHERE s.ticket_id NOT IN (SELECT ticket_id FROM delta)) AS left_only_keys,
  (SELECT count(*) FROM delta d WHERE d.ticket_id NOT IN (SELECT ticket_id FROM store)) AS right_only_keys,
  (SELECT count(*) FROM store) = (SELECT count(*) FROM delta) AS counts_match""")
def _(spark, sf):
    return joins.reconcile(fx.ticket_store(spark, sf), fx.ticket_delta(spark, sf), "ticket_id")


_COPY = """
SELECT CASE WHEN ticket_id % 100 = 7 THEN ticket_id + 1000000000 ELSE ticket_id END AS ticket_id,
  CASE WHEN ticket_id % 100 = 3 THEN upper(subject) || '!' ELSE subject END AS subject,
  CASE WHEN ticket_id % 100 IN (3, 9) THEN NULL ELSE priority END AS priority,
  CASE WHEN ticket_id % 100 = 9 THEN last_modified_ts_utc + INTERVAL '1' HOUR ELSE last_modified_ts_utc END AS last_modified_ts_utc
FROM store WHERE ticket_id % 100 <> 5"""


@query("j11_reconcile_contents", f"""
WITH copied AS ({_COPY})
SELECT coalesce(s.ticket_id, c.ticket_id) AS ticket_id,
  CASE WHEN c.ticket_id IS NULL THEN 'left only' WHEN s.ticket_id IS NULL THEN 'right only' ELSE 'changed' END AS kind,
  CASE WHEN c.ticket_id IS NOT NULL AND s.ticket_id IS NOT NULL THEN concat_ws(',',
    CASE WHEN s.subject IS DISTINCT FROM c.subject THEN 'subject' END, CASE WHEN s.priority IS DISTINCT FROM c.priority THEN 'priority' END,
    CASE WHEN s.last_modified_ts_utc IS DISTINCT FROM c.last_modified_ts_utc THEN 'last_modified_ts_utc' END) END AS fields,
  c.subject AS right_subject
FROM store s FULL JOIN copied c ON c.ticket_id = s.ticket_id
WHERE c.ticket_id IS NULL OR s.ticket_id IS NULL OR s.subject IS DISTINCT FROM c.subject
  OR s.priority IS DISTINCT FROM c.priority OR s.last_modified_ts_utc IS DISTINCT FROM c.last_modified_ts_utc""")
def _(spark, sf):
    """A copy of the store that lacks rows, has others, and differs in fields."""
    store = fx.ticket_store(spark, sf)
    copied = spark.sql(_COPY.replace("FROM store", "FROM {store}"), store=store)
    out = joins.reconcile_contents(store, copied, "ticket_id")
    return out.select("ticket_id", "kind", F.array_join("fields", ",").alias("fields"),
                      F.get_json_object("right_row", "$.subject").alias("right_subject"))
