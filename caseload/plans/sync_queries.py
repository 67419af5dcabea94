"""Upserts, retention, incremental slices, sync state and streaming feeds over the derived tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caseload.operators import sync
from caseload.plans import fixtures as fx
from caseload.plans.catalog import query
from caseload.session import scratch_path
from caseload.sources import files
from caseload.sources.months import MonthTable
from caseload.streaming import feeds
from caseload.streaming.inbox import Inbox

_MERGED = """
SELECT coalesce(s.ticket_id, d.ticket_id) AS ticket_id, coalesce(d.subject, s.subject) AS subject,
  coalesce(d.priority, s.priority) AS priority,
  coalesce(d.last_modified_ts_utc, s.last_modified_ts_utc) AS last_modified_ts_utc
FROM store s FULL JOIN delta d ON d.ticket_id = s.ticket_id"""


@query("u1_upsert_merge", _MERGED)
def _(spark, sf):
    return sync.upsert_merge(fx.ticket_store(spark, sf), fx.ticket_delta(spark, sf), "ticket_id")


@query("u1_upsert_merge_repeated", """
SELECT ticket_id, subject, CASE WHEN subject LIKE '%F' THEN 'late' ELSE lower(priority) END AS priority,
  last_modified_ts_utc + INTERVAL 1 DAY AS last_modified_ts_utc FROM store""")
def _(spark, sf):
    """Two delta rows for each ticket; the later one leaves some fields out."""
    base = fx.ticket_store(spark, sf)
    delta = base.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(
        "ticket_id", "seq", "CAST(NULL AS STRING) AS subject",
        "CASE WHEN seq = 1 THEN lower(priority) WHEN subject LIKE '%F' THEN 'late' END AS priority",
        "last_modified_ts_utc + make_dt_interval(if(seq = 2, 1, 0)) AS last_modified_ts_utc")
    return sync.upsert_merge(base, delta, "ticket_id", "seq")


_REPLACED = """
SELECT * FROM delta UNION ALL SELECT * FROM store s WHERE s.ticket_id NOT IN (SELECT ticket_id FROM delta)"""


@query("u1_merge_stored_months", _MERGED)
def _(spark, sf):
    """The merge into a stored table with month folders; months without a change keep their files."""
    month = F.trunc(F.col("last_modified_ts_utc").cast("date"), "month")
    table = MonthTable(spark, scratch_path(spark, "months"))
    table.write(fx.ticket_store(spark, sf).withColumn("month", month))
    table.merge(fx.ticket_delta(spark, sf).withColumn("month", month), "ticket_id")
    return table.read().drop("month")


@query("u1_upsert_odd_keys", """
SELECT coalesce(s.k, d.k) AS k, coalesce(d.m, s.m) AS m, coalesce(d.n, s.n) AS n
FROM (SELECT nullif(ticket_id, first_id) AS k, 'a=' || subject AS m, 1::BIGINT AS n
    FROM raw_tickets, (SELECT min(ticket_id) AS first_id FROM raw_tickets)) s
FULL JOIN (SELECT nullif(ticket_id, first_id) AS k, CASE WHEN ticket_id % 2 = 0 THEN 'b=' || subject END AS m,
    CASE WHEN ticket_id % 3 > 0 THEN 2::BIGINT END AS n
    FROM raw_tickets, (SELECT min(ticket_id) AS first_id FROM raw_tickets) WHERE ticket_id % 5 < 3 OR ticket_id = first_id) d
  ON s.k IS NOT DISTINCT FROM d.k""")
def _(spark, sf):
    """A missing key and a map column; the change is merged twice."""
    tickets = fx.raw_tickets(spark, sf)
    # A scalar subquery, as a window over the whole table would bring it, and the joins after it, to one task.
    rows = tickets.withColumn("first_id", tickets.select(F.min("ticket_id")).scalar())
    base = rows.selectExpr("nullif(ticket_id, first_id) AS k", "map('a', subject) AS m", "1L AS n")
    delta = rows.where("ticket_id % 5 < 3 OR ticket_id = first_id").selectExpr(
        "nullif(ticket_id, first_id) AS k", "if(ticket_id % 2 = 0, map('b', subject), NULL) AS m", "if(ticket_id % 3 > 0, 2L, NULL) AS n")
    once = sync.upsert_merge(base, delta, "k")
    return sync.upsert_merge(once, delta, "k").selectExpr(
        "k", "concat(map_keys(m)[0], '=', map_values(m)[0]) AS m", "n")


@query("u2_upsert_replace", _REPLACED)
def _(spark, sf):
    return sync.upsert_replace(fx.ticket_store(spark, sf), fx.ticket_delta(spark, sf), "ticket_id")


@query("u3_retain", """
SELECT ticket_id, create_ts_utc FROM tickets WHERE create_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY""")
def _(spark, sf):
    return sync.retain(fx.tickets(spark, sf), "create_ts_utc", 365, fx.TICKETS_AS_OF).select(
        "ticket_id", "create_ts_utc")


@query("u4_incremental", """
SELECT ticket_id, last_modified_ts_utc FROM tickets WHERE last_modified_ts_utc >= TIMESTAMP '2001-06-01'""")
def _(spark, sf):
    return sync.incremental(fx.tickets(spark, sf), dt.datetime(2001, 6, 1), fx.TICKETS_AS_OF).select(
        "ticket_id", "last_modified_ts_utc")


@query("u4_incremental_full", """
SELECT ticket_id, last_modified_ts_utc FROM tickets
WHERE last_modified_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY""")
def _(spark, sf):
    return sync.incremental(
        fx.tickets(spark, sf), dt.datetime(2001, 6, 1), fx.TICKETS_AS_OF, full=True).select(
        "ticket_id", "last_modified_ts_utc")


@query("u5_sync_state", """
SELECT 'chats' AS feed, max(created_ts_utc) AS last_sync, count(*) AS records, 'success' AS status,
  TIMESTAMP '2024-01-31' AS updated_at FROM chats
UNION ALL SELECT 'tickets', max(last_modified_ts_utc), count(*), 'success', TIMESTAMP '2001-08-02' FROM tickets""")
def _(spark, sf):
    tickets = sync.feed_state(fx.tickets(spark, sf), "tickets", "last_modified_ts_utc", fx.TICKETS_AS_OF)
    chats = sync.feed_state(fx.chats(spark, sf), "chats", "created_ts_utc", fx.CHATS_AS_OF)
    old = sync.state_row(spark, "tickets", dt.datetime(1999, 1, 1), 1, "failed", dt.datetime(1999, 1, 1))
    return sync.save_state(sync.save_state(old, tickets), chats)


@query("u6_refresh_metadata", """
SELECT 'tickets' AS table_name, count(*) AS records, TIMESTAMP '2024-01-31' AS last_updated FROM tickets
UNION ALL SELECT 'chats', count(*), TIMESTAMP '2024-01-31' FROM chats""")
def _(spark, sf):
    return sync.refresh_metadata(fx.ticket_store(spark, sf), fx.raw_chats(spark, sf), fx.CHATS_AS_OF)


@query("u6_full_refresh", "SELECT * FROM store WHERE ticket_id % 7 > 0")
def _(spark, sf):
    """A stored table is replaced by another one; rows and months that it lacks go."""
    table = MonthTable(spark, scratch_path(spark, "tickets"))
    rows = fx.ticket_store(spark, sf).withColumn("month", F.trunc(F.col("last_modified_ts_utc").cast("date"), "month"))
    table.write(rows.withColumn("month", F.add_months("month", 1)).withColumn("subject", F.lit("old")))
    table.write(rows.where("ticket_id % 7 > 0"))
    return table.read().drop("month")


@query("u3_retain_stored", """
SELECT * FROM store WHERE last_modified_ts_utc >= TIMESTAMP '2001-08-02' - INTERVAL 500 DAY""")
def _(spark, sf):
    """Retention on stored months: old months are dropped, the border month is rewritten."""
    table = MonthTable(spark, scratch_path(spark, "tickets"))
    table.write(fx.ticket_store(spark, sf).withColumn("month", F.trunc(F.col("last_modified_ts_utc").cast("date"), "month")))
    table.retain("last_modified_ts_utc", 500, fx.TICKETS_AS_OF)
    return table.read().drop("month")


@query("st1_stream_files", """
SELECT file_date, count(*) AS rows, count(nullif(reply_hms, '')) AS replies, min(ticket_id) AS first_id, max(ticket_id) AS last_id
FROM (SELECT *, CAST('2025-09-0' || (1 + ascii(priority) - 49) AS DATE) AS file_date FROM raw_tickets) GROUP BY 1""")
def _(spark, sf):
    """Dated ticket files arrive in a folder, are read once each and appended to a table."""
    inbox, target = scratch_path(spark, "inbox"), scratch_path(spark, "tickets")
    columns = ["ticket_id", "subject", "ticket_owner", "reply_hms"]
    day = F.concat(F.lit("2025-09-0"), F.substring("priority", 1, 1))
    (fx.raw_tickets(spark, sf).withColumn("export", F.concat(F.lit("ticket-export-"), day)).select(*columns, "export")
     .write.partitionBy("export").csv(f"{inbox}/raw", header=True, emptyValue="", escape='"'))
    stream = feeds.stream_files(spark, f"{inbox}/raw", columns)
    # Spark names the files itself, so the date is taken from the folder of the export.
    folder = F.element_at(F.split("source_file", "/"), -2)
    feeds.run_available(
        stream.withColumn("file_date", feeds.file_date(folder)), target, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(target).groupBy("file_date").agg(
        F.count("*").alias("rows"), F.count("reply_hms").alias("replies"),
        F.min(F.col("ticket_id").cast("bigint")).alias("first_id"),
        F.max(F.col("ticket_id").cast("bigint")).alias("last_id"))


def _one_file(df, path: str) -> None:
    """Write a table as one CSV file of this name, in place of what is there."""
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "export")
    files.write_csv(df.coalesce(1), folder)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = [s.getPath() for s in fs.globStatus(jpath(f"{folder}/*.csv"))][0]
    fs.mkdirs(jpath(path).getParent())
    fs.delete(jpath(path), False)
    fs.rename(part, jpath(path))


@query("st1_changed_files", """
SELECT ticket_id, file_date, CASE WHEN subject LIKE '%O' THEN 'second' || chr(10) || 'try, ' || subject ELSE subject END AS subject,
  nullif(priority, '2-HIGH') AS priority, CASE WHEN subject LIKE '%O' THEN ticket_owner END AS ticket_owner
FROM (SELECT *, CAST(CASE right(subject, 1) WHEN 'F' THEN '2025-09-01' WHEN 'O' THEN '2025-09-02' ELSE '2025-09-03' END AS DATE)
  AS file_date FROM raw_tickets)""")
def _(spark, sf):
    """Three exports; one is rewritten under its name with other text and a further column, one comes later."""
    inbox = Inbox(spark, scratch_path(spark, "inbox"), scratch_path(spark, "tickets"))
    rows = fx.raw_tickets(spark, sf).withColumn("priority", F.when(F.col("priority") == "2-HIGH", "None").otherwise(F.col("priority")))
    base = ["ticket_id", "subject", "priority"]
    part = lambda status: rows.where(F.col("subject").endswith(status))
    _one_file(part("F").select(base), f"{inbox.source}/ticket-export-01092025.csv")
    _one_file(part("O").select(base), f"{inbox.source}/ticket-export-02092025.csv")
    inbox.sync()
    again = part("O").withColumn("subject", F.concat(F.lit("second\ntry, "), "subject"))
    _one_file(again.select("ticket_owner", *base), f"{inbox.source}/ticket-export-02092025.csv")
    _one_file(part("P").select(base), f"{inbox.source}/ticket-export-03092025.csv")
    inbox.sync()
    inbox.sync()
    return inbox.read().drop("source_file").withColumn("ticket_id", F.col("ticket_id").cast("bigint"))


@query("st2_file_date", """
SELECT ticket_id, path, CAST(CASE WHEN digits LIKE '20%' THEN try_strptime(digits, '%Y%m%d')
  ELSE try_strptime(digits, '%d%m%Y') END AS DATE) AS file_date
FROM (SELECT *, regexp_replace(path, '[^0-9]', '', 'g') AS digits FROM (SELECT o_orderkey AS ticket_id,
  '/inbox/' || CASE o_orderpriority WHEN '1-URGENT' THEN 'ticket-export-' || strftime(o_orderdate, '%d%m%Y')
    WHEN '2-HIGH' THEN 'chats_' || strftime(o_orderdate, '%d-%m-%Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN '5-LOW' THEN strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m%d') ELSE 'undated' END || '.csv' AS path
  FROM orders))""")
def _(spark, sf):
    name = """'/inbox/' || CASE o_orderpriority
        WHEN '1-URGENT' THEN 'ticket-export-' || date_format(o_orderdate, 'ddMMyyyy')
        WHEN '2-HIGH' THEN 'chats_' || date_format(o_orderdate, 'dd-MM-yyyy')
        WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'yyyy-MM-dd')
        WHEN '5-LOW' THEN date_format(add_months(CAST(o_orderdate AS DATE), 300), 'yyyyMMdd')
        ELSE 'undated' END || '.csv' AS path"""
    files = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS ticket_id", name)
    return files.withColumn("file_date", feeds.file_date(F.col("path")))


@query("st3_stream_upsert", _MERGED)
def _(spark, sf):
    """The change feed is merged into the stored table micro-batch by micro-batch."""
    changes = scratch_path(spark, "changes")
    month = F.expr("date '1992-01-01' + make_interval(0, CAST(ticket_id % 24 AS INT)) AS month")
    delta = fx.ticket_delta(spark, sf).select("*", month)
    delta.repartitionByRange(3, "month").write.parquet(changes)
    table = MonthTable(spark, scratch_path(spark, "store"), fixed=True)
    table.write(fx.ticket_store(spark, sf).select("*", month))
    stream = spark.readStream.schema(delta.schema).option("maxFilesPerTrigger", 1).parquet(changes)
    feeds.stream_upsert(stream, table, "ticket_id", scratch_path(spark, "checkpoint"))
    return table.read().drop("month")


@query("st4_stream_dedup", "SELECT chat_id, created_ts_utc FROM first_chats")
def _(spark, sf):
    """Every chat arrives once although error chats are delivered twice; files come in no order of time."""
    source, target = scratch_path(spark, "chats"), scratch_path(spark, "unique")
    rows = fx.raw_chats(spark, sf).select("chat_id", "load_seq", "created_ts_utc")
    rows.repartition(4, "chat_id", "load_seq").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    feeds.stream_dedup(stream, target, scratch_path(spark, "checkpoint"))
    return feeds.read_deduped(spark, target).select("chat_id", "created_ts_utc")
