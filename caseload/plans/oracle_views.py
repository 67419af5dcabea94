"""DuckDB text of the derived tables in ``fixtures``, written against the same source tables.

It is used only to check results; nothing here runs on Spark.
"""

from __future__ import annotations

_CHAT = """
SELECT event_id AS chat_id, CAST({seq} AS BIGINT) AS load_seq, ts AS created_ts_utc,
  CASE user_id % 10 WHEN 0 THEN 'Wynn AI' WHEN 1 THEN 'Sales Agent' WHEN 2 THEN 'Agent Scrape'
    WHEN 3 THEN 'ChatBot' WHEN 4 THEN 'Shan' WHEN 5 THEN 'Chris' WHEN 6 THEN 'Nora' WHEN 7 THEN 'Gillie'
    WHEN 8 THEN 'Spencer' END AS primary_agent_raw,
  CASE event_id % 6 WHEN 0 THEN 'Chris' WHEN 1 THEN 'Nora' END AS secondary_agent_raw,
  CASE event_id % 6 WHEN 0 THEN 'Chris,Gillie' WHEN 1 THEN ' nora n ' WHEN 2 THEN 'Shan' ELSE '' END AS human_agents,
  CASE event_type WHEN 'signup' THEN 'rated good' WHEN 'error' THEN 'rated bad' WHEN 'view' THEN '4'
    WHEN 'click' THEN '9' ELSE 'not rated' END AS rate_raw,
  CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST((event_id * 53) % 3600 + {seq} AS VARCHAR) END AS duration_raw,
  CAST((event_id * 7) % 600 AS VARCHAR) AS first_response_raw,
  CAST((event_id * 11) % 900 AS VARCHAR) AS avg_response_raw,
  CASE user_id % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB' WHEN 3 THEN 'IN' WHEN 4 THEN 'PH'
    WHEN 5 THEN 'US' END AS country,
  CASE WHEN event_id % 5 = 0 THEN 'chatbot-transfer' END AS tag1, CAST(NULL AS VARCHAR) AS tag2
FROM events
"""

VIEWS: dict[str, str] = {
    "raw_tickets": """
SELECT o_orderkey AS ticket_id,
  o_orderpriority || ' ' || o_orderstatus AS subject, o_orderpriority AS priority,
  o_orderdate + to_minutes(CAST((o_orderkey * 37) % 1440 AS INT)) AS create_ts_utc,
  CASE WHEN o_orderkey % 13 <> 0 THEN
    o_orderdate + to_minutes(CAST((o_orderkey * 37) % 1440 + (o_orderkey * 7919) % 4001 - 200 AS INT))
  END AS first_response_ts_utc,
  o_orderdate + to_minutes(CAST((o_orderkey * 37) % 1440 + (o_orderkey * 101) % 20000 AS INT)) AS last_modified_ts_utc,
  CASE o_custkey % 10 WHEN 0 THEN 'Gillie' WHEN 1 THEN 'Girly E' WHEN 2 THEN 'Nora' WHEN 3 THEN 'Nova'
    WHEN 4 THEN 'Chris S' WHEN 5 THEN 'Francis' WHEN 6 THEN 'Shan D' WHEN 7 THEN 'Bhushan'
    WHEN 8 THEN 'Richie' END AS ticket_owner,
  CASE o_custkey % 11 WHEN 0 THEN '0' WHEN 1 THEN '147307289' WHEN 2 THEN '648529801' WHEN 3 THEN '667370066'
    WHEN 4 THEN '724973238' WHEN 5 THEN '76337708' WHEN 6 THEN '77634704' WHEN 7 THEN '803109779'
    WHEN 8 THEN 'Live Chat ' WHEN 9 THEN '95256452' ELSE '95947431' END AS pipeline_raw,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE
    lpad(CAST(((o_orderkey * 7919) % 4001) // 60 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(((o_orderkey * 7919) % 4001) % 60 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS reply_hms
FROM orders""",
    "tickets": """
SELECT *,
  CASE WHEN isodow(create_ts_local) IN (6, 7) THEN true
       WHEN isodow(create_ts_local) = 5 THEN hour(create_ts_local) >= 18
       WHEN isodow(create_ts_local) = 1 THEN hour(create_ts_local) < 5 ELSE false END AS is_weekend,
  CASE WHEN rtrim(pipeline) = 'Live Chat' THEN 30.0 / 3600
       WHEN first_response_ts_utc > create_ts_utc THEN epoch(first_response_ts_utc - create_ts_utc) / 3600.0
       END AS first_response_hours
FROM (SELECT *,
  (create_ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS create_ts_local,
  CASE WHEN ticket_owner IN ('Girly E', 'Gillie E', 'Gillie') THEN 'Girly'
       WHEN ticket_owner IN ('Nora N', 'Nora') THEN 'Nova'
       WHEN ticket_owner IN ('Chris S', 'Chris') THEN 'Francis'
       WHEN ticket_owner IN ('Shan D', 'Shan') THEN 'Bhushan' ELSE ticket_owner END AS case_owner,
  CASE pipeline_raw WHEN '0' THEN 'Support Pipeline' WHEN '147307289' THEN 'Live Chat'
    WHEN '648529801' THEN 'Upgrades/Downgrades' WHEN '667370066' THEN 'Success'
    WHEN '724973238' THEN 'Customer Onboarding' WHEN '76337708' THEN 'Dev Tickets'
    WHEN '77634704' THEN 'Marketing, Finance' WHEN '803109779' THEN 'Product Testing Requests - Enterprise'
    WHEN '803165721' THEN 'Trial Account Requests - Enterprise'
    WHEN '95256452' THEN 'Enterprise and VIP Tickets' WHEN '95947431' THEN 'SPAM Tickets'
    ELSE pipeline_raw END AS pipeline
  FROM raw_tickets)""",
    "desk": """
SELECT * FROM tickets
WHERE pipeline IS DISTINCT FROM 'SPAM Tickets' AND case_owner IN ('Bhushan', 'Girly', 'Nova', 'Francis')""",
    "comparison": """
SELECT * REPLACE (isodow(create_ts_local) >= 6 AS is_weekend) FROM tickets
WHERE pipeline IS DISTINCT FROM 'SPAM Tickets'""",
    "shown": """
SELECT * REPLACE (CASE trim(pipeline) WHEN 'Support Pipeline' THEN 'Support'
    WHEN 'Enterprise and VIP Tickets' THEN 'Enterprise/VIP' WHEN 'Dev Tickets' THEN 'Dev'
    ELSE coalesce(trim(pipeline), 'Unknown') END AS pipeline)
FROM desk""",
    "raw_chats": _CHAT.format(seq="0") + "UNION ALL" + _CHAT.format(seq="1") + "WHERE event_type = 'error'",
    "chats": """
SELECT *, CAST(created_ts_local AS DATE) AS date, hour(created_ts_local) AS hour,
  dayname(created_ts_local) AS day_of_week, rating_value IS NOT NULL AS has_rating,
  duration_seconds / 60 AS duration_minutes
FROM (SELECT *,
  (created_ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Halifax' AS created_ts_local,
  coalesce(primary_agent_raw, 'Unknown') AS primary_agent,
  coalesce(secondary_agent_raw, '') AS secondary_agent,
  CASE WHEN primary_agent_raw IN ('Wynn AI', 'Sales Agent', 'Agent Scrape', 'ChatBot') THEN 'bot'
       WHEN primary_agent_raw IN ('Shan', 'Chris', 'Nora', 'Gillie') THEN 'human' ELSE 'unknown' END AS agent_type,
  CASE primary_agent_raw WHEN 'Sales Agent' THEN 'Wynn AI' WHEN 'ChatBot' THEN 'Agent Scrape'
    WHEN 'Shan' THEN 'Bhushan' WHEN 'Chris' THEN 'Francis' WHEN 'Nora' THEN 'Nova' WHEN 'Gillie' THEN 'Girly'
    ELSE coalesce(primary_agent_raw, 'Unknown') END AS display_agent,
  CASE WHEN rate_raw LIKE '%bad%' THEN 1.0::DOUBLE WHEN rate_raw LIKE '%good%' THEN 5.0::DOUBLE
    WHEN TRY_CAST(rate_raw AS DOUBLE) BETWEEN 1 AND 5 THEN CAST(rate_raw AS DOUBLE) END AS rating_value,
  coalesce(tag1 = 'chatbot-transfer', false) OR coalesce(tag2 = 'chatbot-transfer', false)
    OR secondary_agent_raw IS NOT NULL AS bot_transfer,
  coalesce(TRY_CAST(duration_raw AS DOUBLE), 0) AS duration_seconds,
  coalesce(TRY_CAST(first_response_raw AS DOUBLE), 0) AS first_response_seconds,
  coalesce(TRY_CAST(avg_response_raw AS DOUBLE), 0) AS avg_response_seconds
  FROM raw_chats)""",
    "first_chats": "SELECT * FROM chats WHERE load_seq = 0",
    "ratings": """
SELECT date, good, bad, good + bad AS total, good * 100.0::DOUBLE / (good + bad) AS satisfaction_pct
FROM (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'signup') AS good,
        count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)
WHERE good + bad > 0""",
    "credited": """
SELECT c.*, a.agent FROM chats c,
  (SELECT unnest(['Shan', 'Girly', 'Chris', 'Nora', 'Gillie', 'Bhushan', 'Francis', 'Nova']) AS agent) a
WHERE c.primary_agent = a.agent OR c.secondary_agent = a.agent""",
    "qa": """
SELECT doc_id AS ticket_id, s.qa_seq,
  CASE WHEN (quality = 1) = (s.qa_seq = 1) THEN 'Meets' ELSE 'Below' END AS overall,
  CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS systemic
FROM labels JOIN (SELECT unnest([1, 2]) AS qa_seq) s ON s.qa_seq = 1 OR toxic = 1""",
    "messages": """
SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN 'customer' WHEN role = 'system' THEN 'system'
       WHEN conv_id % 3 = 0 THEN 'bot' ELSE 'agent' END AS author_type, text,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) + to_seconds(CAST(turn * 45 AS INT)) AS msg_ts_utc
FROM conversations""",
    "logs": """
SELECT event_id AS log_id, ts AS ts_utc,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'purchase' THEN 'SUCCESS'
    ELSE 'INFO' END AS level,
  event_id // 100 AS run_id,
  CASE event_id % 100 WHEN 0 THEN 'INIT' WHEN 99 THEN 'COMPLETE' ELSE 'PROCESSING' END AS stage,
  'event ' || event_type AS message
FROM events""",
    "delta": """
SELECT CASE WHEN o_orderstatus = 'F' THEN ticket_id + 1000000000 ELSE ticket_id END AS ticket_id,
  CASE WHEN o_orderstatus <> 'P' THEN 'changed ' || subject END AS subject,
  CASE WHEN o_orderstatus <> 'O' THEN lower(priority) END AS priority,
  last_modified_ts_utc + to_minutes(60) AS last_modified_ts_utc
FROM raw_tickets JOIN orders ON ticket_id = o_orderkey""",
    "store": "SELECT ticket_id, subject, priority, last_modified_ts_utc FROM raw_tickets",
}

# Week starting on Tuesday and on Monday.
TUE = "CAST(date_trunc('week', {0} - INTERVAL 1 DAY) AS DATE) + 1"
MON = "CAST(date_trunc('week', {0}) AS DATE)"


def with_views(body: str) -> str:
    """The body with the derived tables it mentions, directly or through one another."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
