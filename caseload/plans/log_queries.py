"""Logs, runs and conversations over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.functions import values
from caseload.operators import conversations as conv
from caseload.operators import logs as ops
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.session import scratch_path
from caseload.sources import records

_AS_OF = fx.CHATS_AS_OF


@query("l1_recent_logs", """
SELECT log_id, ts_utc, level, stage, message FROM logs WHERE ts_utc >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR
  AND level = 'ERROR' ORDER BY ts_utc DESC, log_id DESC LIMIT 100""")
def _(spark, sf):
    return ops.recent_logs(fx.logs(spark, sf), _AS_OF, 72, "ERROR", 100).select(
        "log_id", "ts_utc", "level", "stage", "message")


@query("l2_log_stats", """
SELECT level, count(*) AS logs, (SELECT count(*) FROM logs) AS total_logs,
  (SELECT min(ts_utc) FROM logs) AS oldest_log, (SELECT max(ts_utc) FROM logs) AS newest_log FROM logs GROUP BY 1""")
def _(spark, sf):
    return ops.log_stats(fx.logs(spark, sf))


@query("l3_log_retain", "SELECT log_id, ts_utc FROM logs WHERE ts_utc >= TIMESTAMP '2024-01-24'")
def _(spark, sf):
    return ops.log_retain(fx.logs(spark, sf), _AS_OF).select("log_id", "ts_utc")


_READABLE = """CASE WHEN coalesce({0}, 0) = 0 THEN 'N/A' WHEN {0} < 1000 THEN {0} || 'ms'
  WHEN {0} < 60000 THEN printf('%.1fs', {0} / 1000) ELSE printf('%.1fm', {0} / 60000) END"""


@query("l4_run_summary", f"""
SELECT run_id, start_time, end_time, ms AS duration_ms, {_READABLE.format('ms')} AS duration_readable,
  entries, error_count, warning_count, details
FROM (SELECT run_id, min(ts_utc) AS start_time, max(ts_utc) AS end_time,
    CAST(floor(epoch_us(max(ts_utc)) / 1000 - epoch_us(min(ts_utc)) / 1000) AS BIGINT) AS ms0,
    (epoch_us(max(ts_utc)) - epoch_us(min(ts_utc))) // 1000 AS ms,
    count(*) AS entries, count(*) FILTER (WHERE level = 'ERROR') AS error_count,
    count(*) FILTER (WHERE level = 'WARNING') AS warning_count FROM logs GROUP BY 1) r
JOIN (SELECT run_id, string_agg('[' || stage || '] ' || message, ' | ' ORDER BY ts_utc, log_id) AS details
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_utc DESC, log_id DESC) AS rn FROM logs)
  WHERE rn <= 10 GROUP BY 1) d USING (run_id)""".replace(
    "    CAST(floor(epoch_us(max(ts_utc)) / 1000 - epoch_us(min(ts_utc)) / 1000) AS BIGINT) AS ms0,\n", ""))
def _(spark, sf):
    return ops.run_summary(fx.logs(spark, sf))


@query("l5_recent_runs", """
SELECT run_id, start_time, end_time, log_id, ts_utc, level, stage, message
FROM (SELECT l.*, min(ts_utc) OVER (PARTITION BY run_id) AS start_time, max(ts_utc) OVER (PARTITION BY run_id) AS end_time,
  row_number() OVER (PARTITION BY run_id ORDER BY ts_utc DESC, log_id DESC) AS rn FROM logs l)
WHERE rn <= 20 AND run_id IN (SELECT run_id FROM logs GROUP BY 1 ORDER BY max(ts_utc) DESC, run_id DESC LIMIT 20)""")
def _(spark, sf):
    return ops.recent_runs(fx.logs(spark, sf))


@query("l5_entries_since", "SELECT log_id, ts_utc, level FROM logs WHERE ts_utc > TIMESTAMP '2024-01-20 12:00'")
def _(spark, sf):
    import datetime as dt

    return ops.entries_since(fx.logs(spark, sf), dt.datetime(2024, 1, 20, 12)).select("log_id", "ts_utc", "level")


@query("n30_format_duration", f"""
SELECT event_id, ms, {_READABLE.format('ms')} AS readable FROM (
  SELECT event_id, (event_id * 7919) % 200000 AS ms FROM events)""")
def _(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("event_id", "(event_id * 7919) % 200000 AS ms")
    return rows.withColumn("readable", values.readable_ms(F.col("ms")))


def _convs(spark, sf):
    """Conversations with an owner and a deletion mark."""
    return conv.conversations_from_messages(fx.messages(spark, sf)).withColumns({
        "user_id": F.expr("conv_id % 3"), "deleted": F.expr("conv_id % 4 = 0")})


_CONVS = """
WITH convs AS (SELECT conv_id, min(msg_ts_utc) AS created_at, max(msg_ts_utc) AS last_updated,
  count(*) FILTER (WHERE author_type = 'customer') AS query_count,
  arg_min(text, turn) FILTER (WHERE author_type = 'customer') AS first_question,
  conv_id % 3 AS user_id, conv_id % 4 = 0 AS deleted FROM messages GROUP BY conv_id)"""
# The stated moment lies after the first four days of conversations.
_CONV_SQL, _CONV_NOW = "TIMESTAMP '2024-01-10 06:00'", "2024-01-10 06:00"


def _now():
    import datetime as dt

    return dt.datetime.fromisoformat(_CONV_NOW)


@query("v1_conversation_stats", _CONVS + f"""
SELECT count(*) AS total_conversations, count(*) FILTER (WHERE NOT deleted) AS active_conversations,
  CAST(sum(query_count) AS BIGINT) AS total_queries,
  count(*) FILTER (WHERE floor(epoch({_CONV_SQL} - last_updated) / 86400) <= 7) AS recent_conversations FROM convs""")
def _(spark, sf):
    return conv.conversation_stats(_convs(spark, sf), _now())


@query("v2_recent_conversations", _CONVS + """
SELECT conv_id, created_at, last_updated, query_count, left(first_question, 100) || '...' AS preview
FROM convs WHERE user_id = 1 ORDER BY last_updated DESC, conv_id DESC LIMIT 10""")
def _(spark, sf):
    return conv.recent_conversations(_convs(spark, sf), user_id=1)


_PAIRS = """
WITH pairs AS (SELECT q.conv_id, q.turn, q.msg_ts_utc AS asked_at, q.text AS question, coalesce(a.text, '') AS answer,
  row_number() OVER (PARTITION BY q.conv_id ORDER BY q.turn DESC) AS rn
FROM messages q LEFT JOIN messages a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.author_type IN ('agent', 'bot')
WHERE q.author_type = 'customer')"""


@query("v3_conversation_context", _PAIRS + """
SELECT conv_id, turn, question, left(answer, 200) AS summary, asked_at FROM pairs WHERE rn <= 2""")
def _(spark, sf):
    return conv.conversation_context(conv.exchanges(fx.messages(spark, sf)), 2)


@query("v3_context_digest", _PAIRS + """
SELECT conv_id, string_agg('Q: ' || left(question, 100) || '...' || chr(10) || 'A: ' || left(answer, 100) || '...',
  chr(10) ORDER BY turn) AS context_summary FROM pairs WHERE rn <= 3 GROUP BY 1""")
def _(spark, sf):
    return conv.context_digest(conv.exchanges(fx.messages(spark, sf)))


@query("v4_conversation_retain", _CONVS + """
SELECT conv_id, last_updated FROM convs WHERE NOT deleted AND last_updated > TIMESTAMP '2024-01-02 06:00'""")
def _(spark, sf):
    return conv.conversation_retain(_convs(spark, sf), _now(), 8).select("conv_id", "last_updated")


# Records written from the given tables: user and assistant turns that follow each other are one message, and
# every conversation was stored twice, the first time without its last message.
_PAIRED = """
SELECT u.conv_id, u.turn, u.text AS question, coalesce(a.text, '') AS answer, u.msg_ts_utc AS asked_at,
  CASE WHEN u.turn % 3 = 1 THEN 'seen ' || u.conv_id || '/' || u.turn WHEN u.turn % 3 = 2 THEN '' END AS insight
FROM messages u LEFT JOIN messages a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.author_type IN ('agent', 'bot')
WHERE u.author_type = 'customer'"""


def _conversation_file(spark, sf) -> str:
    path = scratch_path(spark, "conversations")
    text = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    pairs = spark.sql(_PAIRED.replace("FROM messages", "FROM {m}").replace("JOIN messages", "JOIN {m}"), m=fx.messages(spark, sf))
    message = F.struct("turn", F.expr(text.format("asked_at")).alias("timestamp"), F.col("question").alias("user_message"),
                       F.col("answer").alias("ai_response"), F.col("insight").alias("data_insights"))
    convs = pairs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(message)).alias("messages"), F.min("asked_at").alias("a"), F.max("asked_at").alias("b"))
    one = convs.select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit("u"), F.col("conv_id") % 3).alias("user_id"),
        F.expr(text.format("a")).alias("created_at"), F.expr(text.format("b")).alias("last_updated"),
        F.transform("messages", lambda m: m.dropFields("turn")).alias("messages"),
        F.size("messages").alias("query_count"), F.expr("if(conv_id % 4 = 0, true, NULL)").alias("deleted"))
    early = one.withColumns({"messages": F.expr("slice(messages, 1, size(messages) - 1)"), "last_updated": F.col("created_at"),
                             "deleted": F.lit(None).cast("boolean"), "query_count": F.col("query_count") - 1}).where("size(messages) > 0")
    early.unionByName(one).write.json(path)
    return path


_RECORDED = f"""
WITH pairs AS ({_PAIRED}), ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM pairs),
convs AS (SELECT conv_id, min(asked_at) AS created_at, max(asked_at) AS last_updated, count(*) AS query_count,
  arg_min(question, turn) AS first_question, conv_id % 4 = 0 AS deleted FROM pairs GROUP BY 1)"""


@query("v1_recorded_conversations", _RECORDED + f"""
SELECT count(*) AS total_conversations, count(*) FILTER (WHERE NOT deleted) AS active_conversations,
  CAST(sum(query_count) AS BIGINT) AS total_queries,
  count(*) FILTER (WHERE floor(epoch({_CONV_SQL} - last_updated) / 86400) <= 7) AS recent_conversations FROM convs""")
def _(spark, sf):
    return conv.conversation_stats(records.read_conversations(spark, _conversation_file(spark, sf)), _now())


@query("v2_recorded_conversations", _RECORDED + """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, created_at, last_updated, query_count, left(first_question, 100) || '...' AS preview
FROM convs WHERE conv_id % 3 = 1 ORDER BY last_updated DESC, CAST(conv_id AS VARCHAR) DESC LIMIT 10""")
def _(spark, sf):
    return conv.recent_conversations(records.read_conversations(spark, _conversation_file(spark, sf)), user_id="u1")


@query("v3_recorded_context", _RECORDED + """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, place AS turn, question, coalesce(nullif(insight, ''), left(answer, 200)) AS summary, asked_at
FROM ranked WHERE rn <= 2""")
def _(spark, sf):
    pairs = records.recorded_exchanges(records.read_conversations(spark, _conversation_file(spark, sf)))
    return conv.conversation_context(pairs, 2, insight="data_insights")


@query("v3_recorded_context_arrays", _RECORDED + """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, place - (SELECT max(place) FROM ranked m WHERE m.conv_id = ranked.conv_id) AS back, question,
  coalesce(nullif(insight, ''), left(answer, 200)) AS summary, asked_at FROM ranked WHERE rn <= 2 AND conv_id % 4 <> 0""")
def _(spark, sf):
    """The same context taken from the arrays, without the deleted conversations."""
    kept = records.recorded_context(records.read_conversations(spark, _conversation_file(spark, sf)), 2)
    return kept.select("conv_id", F.size("context").alias("n"), F.posexplode("context").alias("at", "c")).select(
        "conv_id", (F.col("at") - F.col("n") + 1).alias("back"), "c.*")


@query("v3_recorded_digest", _RECORDED + """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, string_agg('Q: ' || left(question, 100) || '...' || chr(10) || 'A: ' || left(answer, 100) || '...',
  chr(10) ORDER BY turn) AS context_summary FROM ranked WHERE rn <= 3 GROUP BY 1""")
def _(spark, sf):
    return records.recorded_digest(records.read_conversations(spark, _conversation_file(spark, sf)))


def _run_file(spark, sf) -> str:
    path = scratch_path(spark, "runs")
    text = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    entry = F.struct("ts_utc", "log_id", F.expr(text.format("ts_utc")).alias("timestamp"), "level", "stage", "message",
                     F.create_map(F.lit("id"), F.col("log_id").cast("string")).alias("details"))
    runs = fx.logs(spark, sf).groupBy("run_id").agg(
        F.min("ts_utc").alias("a"), F.max("ts_utc").alias("b"),
        F.sort_array(F.collect_list(entry.dropFields("details"))).alias("log_entries"))
    runs.select(
        F.concat(F.lit("run-"), "run_id").alias("run_id"), F.expr(text.format("a")).alias("start_time"),
        F.expr(text.format("b")).alias("end_time"), F.lit("COMPLETED").alias("status"),
        F.expr("(unix_micros(CAST(b AS TIMESTAMP)) - unix_micros(CAST(a AS TIMESTAMP))) div 1000").alias("total_duration_ms"),
        F.transform("log_entries", lambda e: e.dropFields("ts_utc", "log_id")).alias("log_entries")).write.json(path)
    return path


@query("l4_run_records", f"""
SELECT 'run-' || run_id AS run_id, ms AS total_duration_ms, {_READABLE.format('ms')} AS duration_readable, error_count, warning_count, details
FROM (SELECT run_id, (epoch_us(max(ts_utc)) - epoch_us(min(ts_utc))) // 1000 AS ms, count(*) FILTER (WHERE level = 'ERROR') AS error_count,
    count(*) FILTER (WHERE level = 'WARNING') AS warning_count FROM logs GROUP BY 1) r
JOIN (SELECT run_id, string_agg('[' || stage || '] ' || message, ' | ' ORDER BY ts_utc, log_id) AS details
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_utc DESC, log_id DESC) AS rn FROM logs)
  WHERE rn <= 10 GROUP BY 1) d USING (run_id)""")
def _(spark, sf):
    return ops.run_details(records.read_runs(spark, _run_file(spark, sf))).select(
        "run_id", "total_duration_ms", "duration_readable", "error_count", "warning_count", "details")


@query("l5_run_records", """
SELECT 'run-' || run_id AS run_id, start_time, level, stage, message, ts_utc
FROM (SELECT l.*, min(ts_utc) OVER (PARTITION BY run_id) AS start_time,
  row_number() OVER (PARTITION BY run_id ORDER BY ts_utc DESC, log_id DESC) AS rn FROM logs l)
WHERE rn <= 20 AND run_id IN (SELECT run_id FROM logs GROUP BY 1 ORDER BY min(ts_utc) DESC, 'run-' || run_id DESC LIMIT 15)""")
def _(spark, sf):
    runs = records.recent_run_records(records.read_runs(spark, _run_file(spark, sf)), 15)
    return records.entries_of(runs).join(runs.select("run_id", "start_time"), "run_id").select(
        "run_id", "start_time", "level", "stage", "message", "ts_utc")
