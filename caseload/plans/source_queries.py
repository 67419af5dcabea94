"""Sources, sinks and payloads. Files are written from the derived tables and read back whole."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseload import schema
from caseload.operators import chats as chat_ops
from caseload.operators import tickets as ticket_ops
from caseload.operators import widgets
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query, same_rows
from caseload.plans.oracle_views import TUE
from caseload.session import scratch_path
from caseload.sources import files, payloads, tables
from caseload.sources.csv_scan import CsvScan

_STAMP = "date_format({0}, 'yyyy-MM-dd HH:mm:ss')"


def _exports(spark, sf):
    """Three ticket exports with different columns; missing values are written as text tokens."""
    rows = fx.raw_tickets(spark, sf).selectExpr(
        "right(subject, 1) AS status", "CAST(ticket_id AS STRING) AS `Ticket ID`", "subject AS `Subject`",
        "pipeline_raw AS `Pipeline`", "coalesce(ticket_owner, 'None') AS `Ticket owner`",
        f"{_STAMP.format('create_ts_utc')} AS `Create date`",
        f"coalesce({_STAMP.format('first_response_ts_utc')}, 'NULL') AS `First agent email response date`",
        "reply_hms AS `Time to first agent email reply (HH:mm:ss)`")
    base = scratch_path(spark, "exports")
    shapes = {"F": ["Time to first agent email reply (HH:mm:ss)"], "O": [], "P": ["Subject"]}
    for status, missing in shapes.items():
        part = rows.where(F.col("status") == status).drop("status", *missing)
        files.write_csv(part, f"{base}/tickets/export_{status}.csv")
    return base


@query("s1_read_tickets_csv", """
SELECT ticket_id, CASE WHEN subject NOT LIKE '%P' THEN subject END AS subject, case_owner, pipeline, create_ts_local,
  first_response_hours, is_weekend, CASE WHEN subject LIKE '%F' THEN NULL ELSE nullif(reply_hms, '') END AS reply_hms
FROM tickets""", "first_response_hours")
def _(spark, sf):
    """Read the exports, map their columns and normalise."""
    raw = files.read_tickets_csv(spark, _exports(spark, sf))
    logical = schema.resolve_columns(raw, schema.TICKET_COLUMNS).withColumnRenamed("pipeline", "pipeline_raw")
    # A trailing blank in a pipeline name survives the file.
    return ticket_ops.normalize_tickets(logical).select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"), "subject", "case_owner", "pipeline",
        "create_ts_local", "first_response_hours", "is_weekend", "reply_hms")


@query("s2_read_chats_csv", """
SELECT chat_id, load_seq, created_ts_local, display_agent, agent_type, rating_value, bot_transfer, duration_minutes
FROM chats""", "rating_value duration_minutes")
def _(spark, sf):
    base = scratch_path(spark, "chat-exports")
    stamp = "date_format(created_ts_utc, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    rows = fx.raw_chats(spark, sf)
    new = rows.where("load_seq = 0").selectExpr(
        "chat_id", "load_seq", f"{stamp} AS `chat creation date America/Moncton`", "primary_agent_raw AS `operator 1 nick`",
        "secondary_agent_raw AS `operator 2 nick`", "rate_raw AS rate", "duration_raw AS `chat duration in seconds`",
        "tag1 AS `tag 1`")
    old = rows.where("load_seq = 1").selectExpr(
        "chat_id", "load_seq", "tag1 AS `tag 1`", f"{stamp} AS `chat creation date America/Moncton`",
        "primary_agent_raw AS `operator 1 nick`", "secondary_agent_raw AS `operator 2 nick`", "rate_raw AS rate",
        "duration_raw AS `chat duration in seconds`", "country AS `visitor country code`")
    files.write_csv(new, f"{base}/chats_report_new.csv")
    files.write_csv(old, f"{base}/chats_report_old.csv")
    raw = files.read_chats_csv(spark, base)
    logical = schema.resolve_columns(raw, {**schema.CHAT_COLUMNS, "load_seq": ["load_seq"]})
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    logical = logical.withColumns({c: blank(c) for c in ("primary_agent_raw", "secondary_agent_raw", "tag1")})
    return chat_ops.normalize_chats(logical).select(
        F.col("chat_id").cast("bigint").alias("chat_id"), F.col("load_seq").cast("bigint").alias("load_seq"),
        "created_ts_local", "display_agent", "agent_type", "rating_value", "bot_transfer", "duration_minutes")


@query("s3_classify_files", """
SELECT path, length, CASE WHEN folder = 'tickets' THEN 'tickets' WHEN folder = 'chats' THEN 'chats'
  WHEN name LIKE '%conversation%' THEN 'chats' ELSE 'tickets' END AS kind
FROM (SELECT '/data/' || folder || '/' || name || '-' || event_id || ext AS path, (event_id * 37) % 5000 AS length, folder, name, ext
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tickets' WHEN 1 THEN 'chats' ELSE 'uploads' END AS folder,
    CASE event_type WHEN 'view' THEN 'Chat_Rating' WHEN 'click' THEN 'prechat' WHEN 'error' THEN 'export'
      WHEN 'signup' THEN 'conversation' ELSE 'readme' END AS name,
    CASE user_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.csv.processed' ELSE '.txt' END AS ext FROM events))
WHERE CASE folder WHEN 'tickets' THEN ext <> '.txt' WHEN 'chats' THEN ext = '.csv' AND name IN ('Chat_Rating', 'prechat')
    ELSE ext = '.csv' END
  AND NOT (folder = 'uploads' AND name = 'never')""".replace(
    "WHEN name LIKE '%conversation%'", "WHEN name IN ('conversation', 'Chat_Rating', 'prechat')"))
def _(spark, sf):
    listing = fx.table(spark, sf, "events").selectExpr(
        "concat('/data/', CASE event_id % 3 WHEN 0 THEN 'tickets' WHEN 1 THEN 'chats' ELSE 'uploads' END, '/', "
        "CASE event_type WHEN 'view' THEN 'Chat_Rating' WHEN 'click' THEN 'prechat' WHEN 'error' THEN 'export' "
        "WHEN 'signup' THEN 'conversation' ELSE 'readme' END, '-', event_id, "
        "CASE user_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.csv.processed' ELSE '.txt' END) AS path",
        "(event_id * 37) % 5000 AS length")
    return files.classify_files(listing)


@query("s3_discover", """
SELECT ticket_id, subject, CASE WHEN subject LIKE '%F' THEN 'tickets' ELSE 'uploads' END AS folder FROM raw_tickets
WHERE subject NOT LIKE '%P'""")
def _(spark, sf):
    """Exports in three folders; what discovery calls tickets is read whole. A chats folder takes only reports by name."""
    base = scratch_path(spark, "data")
    rows = fx.raw_tickets(spark, sf).select("ticket_id", "subject")
    for status, folder in {"F": "tickets", "O": "uploads", "P": "chats"}.items():
        files.write_csv(rows.where(F.col("subject").endswith(status)), f"{base}/{folder}")
    found = [r["path"] for r in files.discover(spark, base).where("kind = 'tickets'").collect()]
    read = CsvScan(spark, found)
    return read.rows.select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"), "subject",
        F.element_at(F.split(CsvScan.FILE, "/"), -2).alias("folder"))


@query("s4_latest_table", "SELECT ticket_id, subject, priority, last_modified_ts_utc FROM delta")
def _(spark, sf):
    """Two exports of the ticket table; the later one is the table."""
    base = scratch_path(spark, "inbox")
    files.write_csv(fx.ticket_store(spark, sf), f"{base}/a-first.csv")
    files.write_csv(fx.ticket_delta(spark, sf), f"{base}/b-second.csv")
    return files.latest_table(spark, base).select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"), F.nullif("subject", F.lit("")).alias("subject"),
        F.nullif("priority", F.lit("")).alias("priority"), F.col("last_modified_ts_utc").cast("timestamp_ntz").alias("last_modified_ts_utc"))


@query("s5_read_ragged", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS owner FROM orders""")
def _(spark, sf):
    """Lines with two to six cells under a header of four."""
    lines = fx.table(spark, sf, "orders").selectExpr(
        "concat_ws(',', o_orderkey, o_orderpriority, if(o_orderstatus = 'F', NULL, o_orderstatus), "
        "if(o_orderstatus = 'O', concat(o_custkey, ',beyond,the header'), NULL)) AS value")
    return files.read_ragged(lines, ["id", "priority", "status", "owner"])


@query("s6_apply_types", """
SELECT ticket_id, create_ts_utc AS created, CAST(ticket_id AS DOUBLE) AS number,
  CASE WHEN priority = '1-URGENT' THEN NULL ELSE subject LIKE '%F' END AS flag FROM raw_tickets""", "number")
def _(spark, sf):
    text = fx.raw_tickets(spark, sf).selectExpr(
        "ticket_id", f"{_STAMP.format('create_ts_utc')} AS created", "concat(' ', ticket_id) AS number",
        "CASE WHEN priority = '1-URGENT' THEN 'maybe' ELSE CAST(subject LIKE '%F' AS STRING) END AS flag")
    return schema.apply_types(text, dates=["created", "absent"], numbers=["number"], booleans=["flag"])


@query("s7_get_tickets", """
SELECT ticket_id, create_ts_utc, case_owner, pipeline FROM tickets
WHERE create_ts_utc BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-12-31' AND pipeline = 'Success' AND case_owner = 'Nova'
ORDER BY create_ts_utc DESC, ticket_id LIMIT 50""")
def _(spark, sf):
    return tables.get_tickets(
        fx.tickets(spark, sf), dt.datetime(1997, 1, 1), dt.datetime(2000, 12, 31), "Success", "Nova", 50).select(
        "ticket_id", "create_ts_utc", "case_owner", "pipeline")


@query("s7_stored_tickets", """
SELECT case_owner, count(*) AS tickets, max(create_ts_local) AS newest FROM tickets
WHERE create_ts_utc BETWEEN TIMESTAMP '1998-02-10' AND TIMESTAMP '1998-11-20' GROUP BY 1""")
def _(spark, sf):
    """The normalised table stored in month folders; the range reads ten of them."""
    path = scratch_path(spark, "stored")
    tables.store_by_month(fx.tickets(spark, sf), path, "create_ts_utc")
    stored = spark.read.parquet(path)
    return tables.get_tickets(stored, dt.datetime(1998, 2, 10), dt.datetime(1998, 11, 20)).groupBy("case_owner").agg(
        F.count("*").alias("tickets"), F.max("create_ts_local").alias("newest"))


@query("s8_get_chats", """
SELECT chat_id, created_ts_utc, agent_type, display_agent FROM first_chats
WHERE created_ts_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND agent_type = 'bot'
  AND display_agent = 'Agent Scrape' ORDER BY created_ts_utc DESC, chat_id LIMIT 75""")
def _(spark, sf):
    from caseload.operators.joins import dedup

    chats = dedup(fx.chats(spark, sf), "chat_id", ["load_seq"])
    return tables.get_chats(
        chats, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25), "bot", "Agent Scrape", 75).select(
        "chat_id", "created_ts_utc", "agent_type", "display_agent")


@query("s9_dataset_info", """
SELECT count(*) AS records, 'ticket_id, subject, create_ts_utc' AS columns, min(create_ts_utc) AS first_ts,
  max(create_ts_utc) AS last_ts FROM raw_tickets""")
def _(spark, sf):
    return tables.dataset_info(
        fx.raw_tickets(spark, sf).select("ticket_id", "subject", "create_ts_utc"), "create_ts_utc")


@query("s10_explode_ratings", "SELECT * FROM ratings", "satisfaction_pct")
def _(spark, sf):
    return payloads.explode_ratings(fx.ratings_map(spark, sf))


@query("s11_flatten_tickets", """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, subject, pipeline_raw AS hs_pipeline, CAST(NULL AS VARCHAR) AS content,
  strftime(create_ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS created_at, CAST(NULL AS VARCHAR) AS updated_at FROM raw_tickets""")
def _(spark, sf):
    nested = fx.raw_tickets(spark, sf).selectExpr(
        "CAST(ticket_id AS STRING) AS id", "date_format(create_ts_utc, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS createdAt",
        "CAST(NULL AS STRING) AS updatedAt", "map('subject', subject, 'hs_pipeline', pipeline_raw) AS properties")
    return payloads.flatten_tickets(nested, ["subject", "hs_pipeline", "content"])


@query("s12_write_csv", """
SELECT ticket_id, subject, priority, case_owner, pipeline, create_ts_utc, create_ts_local, first_response_ts_utc, last_modified_ts_utc,
  first_response_hours, is_weekend, nullif(reply_hms, '') AS reply_hms FROM tickets""", "first_response_hours")
def _(spark, sf):
    """Written as CSV and read back whole."""
    path = scratch_path(spark, "processed")
    files.write_csv(fx.tickets(spark, sf), path)
    raw = files.read_tickets_csv(spark, path)
    text, stamps = ["subject", "priority", "case_owner", "pipeline", "reply_hms"], [
        "create_ts_utc", "create_ts_local", "first_response_ts_utc", "last_modified_ts_utc"]
    return raw.select(
        F.col("ticket_id").cast("bigint").alias("ticket_id"), *text, *[F.col(c).cast("timestamp_ntz").alias(c) for c in stamps],
        F.col("first_response_hours").cast("double").alias("first_response_hours"), F.col("is_weekend").cast("boolean").alias("is_weekend"))


@query("s13_export_strings", """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, subject, coalesce(case_owner, '') AS case_owner,
  strftime(create_ts_local, '%Y-%m-%dT%H:%M:%S') AS create_ts_local,
  coalesce(strftime(first_response_ts_utc, '%Y-%m-%dT%H:%M:%S'), '') AS first_response_ts_utc,
  CAST(is_weekend AS VARCHAR) AS is_weekend, '2001-08-02 00:00:00' AS Last_Updated, 'tickets' AS Data_Type
FROM tickets WHERE create_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY""")
def _(spark, sf):
    cols = ["ticket_id", "subject", "case_owner", "create_ts_local", "first_response_ts_utc", "is_weekend"]
    return tables.export_strings(fx.tickets(spark, sf), "tickets", fx.TICKETS_AS_OF, 365, cols)


@query("s13_export_tickets", """
SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, strftime(create_ts_local, '%Y-%m (%B)') AS month_year,
  year(create_ts_local) || '-Q' || quarter(create_ts_local) AS fy_quarter_full,
  coalesce(CAST(round(CAST(first_response_hours AS DECIMAL(38,12)), 2)::DOUBLE AS VARCHAR), '') AS response_hours_clean,
  CAST(round(CAST(epoch(TIMESTAMP '2001-08-02' - create_ts_utc) / 86400 AS DECIMAL(38,12)), 1)::DOUBLE AS VARCHAR) AS ticket_age_days,
  '' AS "QA - Channel"
FROM tickets WHERE create_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY""")
def _(spark, sf):
    return tables.export_tickets(fx.tickets(spark, sf), fx.TICKETS_AS_OF).select(
        "ticket_id", "month_year", "fy_quarter_full", "response_hours_clean", "ticket_age_days", "`QA - Channel`")


@query("s13_export_chats", """
SELECT CAST(chat_id AS VARCHAR) AS chat_id, CAST(load_seq AS VARCHAR) AS load_seq, dayname(created_ts_local) AS day_name,
  CASE WHEN hour <= 6 THEN 'Night (0-6)' WHEN hour <= 12 THEN 'Morning (6-12)' WHEN hour <= 18 THEN 'Afternoon (12-18)'
    ELSE 'Evening (18-24)' END AS time_period,
  CAST(round(CAST(duration_seconds / 60 AS DECIMAL(38,12)), 2)::DOUBLE AS VARCHAR) AS duration_minutes
FROM chats WHERE created_ts_utc >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""")
def _(spark, sf):
    return tables.export_chats(fx.chats(spark, sf), fx.CHATS_AS_OF, 20).select(
        "chat_id", "load_seq", "day_name", "time_period", "duration_minutes")


@query("s13_export_long_text", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 49000 THEN left(text, 49000) || '...[TRUNCATED]'
  WHEN text IN ('NaT', 'nan', 'NaN', 'None', '<NA>') THEN '' ELSE text END AS text,
  '2001-08-02 00:00:00' AS Last_Updated, 'documents' AS Data_Type FROM documents""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return tables.export_strings(docs, "documents", fx.TICKETS_AS_OF)


_PROFILE = {"ticket_id": "bigint", "subject": "string", "ticket_owner": "string", "reply_hms": "string"}


@query("s14_profile", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS type, count({c}) AS present, "
    f"min(CAST({c} AS VARCHAR)) AS sample, count(*) AS rows FROM raw_tickets"
    for i, (c, t) in enumerate(_PROFILE.items())))
def _(spark, sf):
    view = tables.register(fx.raw_tickets(spark, sf).select(*_PROFILE), "ticket_profile_input")
    return tables.profile(view)


DIRECTORY = {"a1": ("Nora", "agent"), "b7": ("Helper Bot", "agent")}
_BOT = "5626186ef1d50006d82a02372509ec3e"


def _chat_payloads(spark, sf):
    """One payload per event: participants, thread events, rating and tags from its numbers."""
    at = lambda s: (
        f"date_format(ts + make_dt_interval(0, 0, 0, {s}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")")
    user = lambda cond, i, kind: f"if({cond}, named_struct('id', '{i}', 'type', '{kind}'), NULL)"
    users = ", ".join([
        user("true", "c0", "customer"), user("event_id % 3 <> 0", _BOT, "bot"), user("event_id % 4 = 0", "a1", "agent"),
        user("event_id % 5 = 0", "zz", "agent"), user("event_id % 7 = 0", "b7", "agent")])
    said = lambda kind, when, who: (
        f"named_struct('type', '{kind}', 'created_at', {when}, 'author_type', {who})")
    reply = said("message", at("5 + event_id % 50"), "if(event_id % 3 <> 0, 'bot', 'agent')")
    events = (f"if(event_type = 'view', array(), array_compact(array({said('system', at('0'), 'NULL')}, "
              f"{said('message', at('10'), chr(39) + 'customer' + chr(39))}, if(event_id % 2 = 0, {reply}, NULL), "
              f"{said('closed', at('60 + event_id % 900'), 'NULL')})))")
    df = fx.table(spark, sf, "events").selectExpr(
        "CAST(event_id AS STRING) AS id", f"if(event_type = 'click', NULL, {at('0')}) AS created_at",
        "CAST(NULL AS STRING) AS started_at", "CAST(NULL AS STRING) AS last_event_created_at",
        f"array_compact(array({users})) AS users",
        f"named_struct('created_at', {at('0')}, 'started_at', {at('0')}, 'ended_at', {at('event_id % 600')}, "
        f"'last_event_created_at', CAST(NULL AS STRING), 'events', {events}) AS thread",
        "named_struct('rating', if(user_id % 6 = 0, NULL, named_struct('score', CAST(user_id % 6 AS INT), 'comment', "
        "if(event_type = 'error', 'bad', NULL))), 'source', if(event_type = 'purchase', NULL, named_struct('type', 'widget'))) "
        "AS properties",
        "array_compact(array(event_type, if(event_id % 5 = 0, 'chatbot-transfer', NULL))) AS tags")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.CHAT_PAYLOAD.fields])


@query("n24_parse_chat_payload", """
SELECT CAST(event_id AS VARCHAR) AS chat_id, ts AS created_ts_utc, primary_agent,
  CASE WHEN kind = 'bot' THEN bot ELSE primary_agent END AS display_agent, kind AS agent_type, bot <> '' AND humans <> '' AS bot_transfer,
  CASE WHEN score >= 4 THEN 'rated good' WHEN score <= 2 THEN 'rated bad' ELSE 'not rated' END AS rate_raw,
  CAST(score AS DOUBLE) AS rating_value, CASE WHEN score IS NOT NULL AND event_type = 'error' THEN 'bad' ELSE '' END AS rating_comment,
  score IS NOT NULL AS has_rating, CASE WHEN event_type = 'purchase' THEN 'unknown' ELSE 'widget' END AS source,
  event_type || CASE WHEN event_id % 5 = 0 THEN ',chatbot-transfer' ELSE '' END AS tags,
  CASE WHEN event_type = 'view' THEN event_id % 600 ELSE 60 + event_id % 900 END / 60 AS duration_minutes,
  CASE WHEN event_type <> 'view' AND event_id % 2 = 0 THEN greatest(event_id % 50 - 5, 0) END AS first_response_seconds,
  humans AS human_agents, bot AS bot_agent, num_agents
FROM (SELECT *, CASE WHEN bot <> '' AND humans = '' THEN 'bot' ELSE 'human' END AS kind FROM (SELECT *,
  CASE WHEN event_id % 3 <> 0 THEN 'Agent Scrape' WHEN event_id % 4 = 0 THEN 'Nora' WHEN event_id % 5 = 0 THEN 'Unknown'
    WHEN event_id % 7 = 0 THEN 'Helper Bot' END AS primary_agent,
  CASE WHEN event_id % 7 = 0 THEN 'Helper Bot' WHEN event_id % 3 <> 0 THEN 'Agent Scrape' ELSE '' END AS bot,
  concat_ws(',', CASE WHEN event_id % 4 = 0 THEN 'Nora' END, CASE WHEN event_id % 5 = 0 THEN 'Unknown' END) AS humans,
  CASE WHEN user_id % 6 > 0 THEN user_id % 6 END AS score,
  CAST((event_id % 3 <> 0)::INT + (event_id % 4 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT AS BIGINT) AS num_agents
  FROM events))""", "rating_value duration_minutes first_response_seconds")
def _(spark, sf):
    return payloads.parse_chat_payload(_chat_payloads(spark, sf), DIRECTORY)


def _as_json(df, shape: str):
    """The payloads as JSON text in one of the API's shapes."""
    thread = F.col("thread")
    if shape == "threads":
        other = F.struct(F.lit("1999-01-01T00:00:00Z").alias("created_at"))
        df = df.withColumn("threads", F.array(thread, F.struct(other["created_at"], *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema["thread"].dataType.fields[1:]]))).drop("thread")
    if shape == "times":
        df = df.withColumns({
            "started_at": F.when(F.col("event_type") == "view", F.col("created_at")),
            "last_event_created_at": F.when(F.col("event_type") != "view", F.col("created_at")),
            "created_at": F.lit(""),
            "thread": thread.withField("last_event_created_at", thread["ended_at"]).withField("ended_at", F.lit(None).cast("string"))})
    if shape == "tags":
        df = df.withColumn("tags", F.transform("tags", lambda t: F.struct(F.lit(7).alias("id"), t.alias("name"))))
    whole = F.struct(*[c for c in df.columns if c != "event_type"])
    text = F.to_json(F.struct(F.lit("ok").alias("status"), whole.alias("chat")) if shape == "wrapped" else whole)
    if shape == "items":
        value = lambda n: F.coalesce(F.to_json(f"properties.{n}"), F.lit("null"))
        items = F.concat(*[x for n in ("rating", "source") for x in (F.lit(f',{{"name":"{n}","value":'), value(n), F.lit("}"))])
        rest = F.to_json(F.struct(*[c for c in df.columns if c not in ("event_type", "properties")]))
        text = F.concat(F.expr("left(rest, length(rest) - 1)"), F.lit(',"properties":{"items":['), F.substring("items", 2, 10_000), F.lit("]}}"))
        return df.withColumns({"rest": rest, "items": items}).select(text.alias("payload"))
    return df.select(text.alias("payload"))


def _directory(spark):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in DIRECTORY.items()], "id string, name string, type string")


def _from_json(spark, sf, shape: str):
    rows = _chat_payloads(spark, sf)
    kind = F.element_at("tags", 1).alias("event_type")
    return payloads.parse_chat_payload(payloads.chat_payloads(_as_json(rows.select("*", kind), shape)), _directory(spark))


for _shape in ("plain", "wrapped", "threads", "times", "items", "tags"):

    @same_rows(f"n24_payload_{_shape}", "n24_parse_chat_payload")
    def _(spark, sf, shape=_shape):
        """The same chats as JSON text in another shape of the API."""
        return _from_json(spark, sf, shape)


# The payloads after N24, N1 and N6, in SQL.
_REPORTED = f"""
SELECT chat_id, created_ts_utc, (created_ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Halifax' AS created_ts_local,
  coalesce(primary_agent, 'Unknown') AS primary_agent,
  CASE primary_agent WHEN 'Nora' THEN 'Nova' ELSE coalesce(primary_agent, 'Unknown') END AS display_agent,
  CASE primary_agent WHEN 'Agent Scrape' THEN 'bot' WHEN 'Nora' THEN 'human' ELSE 'unknown' END AS agent_type,
  human_agents <> '' OR tags = 'chatbot-transfer' AS bot_transfer, rating_value,
  duration_minutes, coalesce(first_response_seconds, 0) AS first_response_seconds
FROM ({{}})"""


def _reported() -> str:
    from caseload.plans.catalog import ORACLES

    return _REPORTED.format(ORACLES["n24_parse_chat_payload"])


def _chats_of_payloads(spark, sf):
    parsed = _from_json(spark, sf, "wrapped")
    return chat_ops.normalize_chats(schema.resolve_columns(parsed, schema.CHAT_COLUMNS))


@query("n24_payload_normalised", _reported(), "rating_value duration_minutes first_response_seconds")
def _(spark, sf):
    """Payload, N24, N1 and N6 in a row: time, response and duration survive."""
    return _chats_of_payloads(spark, sf).select(
        "chat_id", "created_ts_utc", "created_ts_local", "primary_agent", "display_agent", "agent_type", "bot_transfer",
        "rating_value", "duration_minutes", "first_response_seconds")


@query("w7_payload", f"""
SELECT period, strftime(period, '%Y-%m-%d') AS label, total, bot, human,
  regr_slope(CAST(total AS DOUBLE), x) OVER () * x + regr_intercept(CAST(total AS DOUBLE), x) OVER () AS trend
FROM (SELECT {TUE.format('created_ts_local')} AS period, count(*) AS total, count(*) FILTER (WHERE NOT bot_transfer) AS bot,
    count(*) FILTER (WHERE bot_transfer) AS human, row_number() OVER (ORDER BY {TUE.format('created_ts_local')}) - 1 AS x
  FROM ({_reported()}) GROUP BY 1)""", "trend")
def _(spark, sf):
    return widgets.chat_weekly_volume_breakdown(_chats_of_payloads(spark, sf), fx.CHATS_AS_OF, range_="all")


@query("w9_payload", f"""
SELECT display_agent AS bot, count(*) AS chats, avg(duration_minutes) AS mean_duration FROM ({_reported()})
WHERE agent_type = 'bot' GROUP BY 1""", "mean_duration")
def _(spark, sf):
    return widgets.bot_volume_duration(_chats_of_payloads(spark, sf), fx.CHATS_AS_OF, range_="all")


@query("w14_payload", f"""
SELECT CAST(created_ts_local AS DATE) AS date, count(*) AS chats, count(*) FILTER (WHERE bot_transfer) AS transfers,
  count(*) FILTER (WHERE bot_transfer) * 100.0 / count(*) AS transfer_rate, 0.0::DOUBLE AS satisfaction_pct
FROM ({_reported()}) GROUP BY 1""", "transfer_rate satisfaction_pct")
def _(spark, sf):
    none = payloads.explode_ratings(fx.ratings_map(spark, sf)).where("false")
    return widgets.daily_chat_trends_performance(_chats_of_payloads(spark, sf), none, fx.CHATS_AS_OF, range_="all")


@same_rows("s11_ticket_payloads", "s11_flatten_tickets")
def _(spark, sf):
    """Pages of JSON tickets; some are single objects, all hold more than is asked for."""
    rows = fx.raw_tickets(spark, sf).selectExpr(
        "ticket_id", "CAST(ticket_id AS STRING) AS id", "date_format(create_ts_utc, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS createdAt",
        "named_struct('subject', subject, 'hs_pipeline', pipeline_raw, 'nested', named_struct('a', 1)) AS properties",
        "array(1, 2) AS associations")
    one = F.struct("id", "createdAt", "properties", "associations")
    pages = rows.where("ticket_id % 3 > 0").groupBy(F.expr("ticket_id div 20")).agg(
        F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("payload")).select("payload")
    single = rows.where("ticket_id % 3 = 0").select(F.to_json(one).alias("payload"))
    return payloads.flatten_tickets(
        payloads.ticket_payloads(pages.union(single)), ["subject", "hs_pipeline", "content"])
