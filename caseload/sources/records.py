"""JSON-lines records with nested arrays: conversations with their messages, processing runs with their entries.

A record is one row and stays one: what the reports need of an array is taken by array functions inside the row,
so nothing is shuffled for it. A line that is no JSON object gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions import times

CONVERSATION = (
    "conversation_id string, user_id string, created_at string, last_updated string, context_summary string, query_count bigint, "
    "deleted boolean, deleted_at string, messages array<struct<timestamp:string,user_message:string,ai_response:string,"
    "sql_query:string,data_insights:string>>")
RUN = (
    "run_id string, start_time string, end_time string, status string, analytics_type string, date_range string, "
    "files_processed array<string>, records_processed bigint, sheets_updated boolean, spreadsheet_id string, spreadsheet_url string, "
    "total_duration_ms bigint, log_entries array<struct<timestamp:string,level:string,stage:string,message:string,"
    "details:map<string,string>,duration_ms:bigint>>")


def _read(spark: SparkSession, path: str, shape: str, key: str) -> DataFrame:
    return spark.read.schema(shape).option("mode", "PERMISSIVE").json(path).where(F.col(key).isNotNull())


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """V1 to V4: one row per conversation; times are UTC, a record without messages has an empty array.

    The store appends a conversation anew whenever it changes, so the last update of an id counts, and of equal ones
    the longest.
    """
    rows = _read(spark, path, CONVERSATION, "conversation_id").withColumns({
        "created_at": times.parse_iso(F.col("created_at")), "last_updated": times.parse_iso(F.col("last_updated")),
        "deleted": F.coalesce("deleted", F.lit(False)), "query_count": F.coalesce("query_count", F.lit(0).cast("bigint")),
        "messages": F.coalesce("messages", F.expr("cast(array() as array<struct<timestamp:string,user_message:string,"
                                                  "ai_response:string,sql_query:string,data_insights:string>>)"))})
    row = F.struct(*[c for c in rows.columns if c != "conversation_id"])
    last = F.max_by(row, F.struct("last_updated", F.size("messages"), "deleted", F.xxhash64(F.to_json("messages"))))
    one = rows.groupBy("conversation_id").agg(last.alias("r"))
    return one.select(F.col("conversation_id").alias("conv_id"), "r.*").withColumn(
        "first_question", F.get("messages", F.lit(0))["user_message"])


def recorded_exchanges(convs: DataFrame) -> DataFrame:
    """V3: the exchanges as recorded, one row per message, in the columns of ``conversations.exchanges``."""
    return convs.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), times.parse_iso(F.col("m.timestamp")).alias("asked_at"),
        F.col("m.user_message").alias("question"), F.coalesce("m.ai_response", F.lit("")).alias("answer"),
        "m.sql_query", "m.data_insights")


def _last(array, n: int):
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), n)


def recorded_context(convs: DataFrame, n: int = 5, summary: int = 200) -> DataFrame:
    """V3: per conversation the last ``n`` exchanges, the insight or else the beginning of the answer as summary."""
    entry = lambda m: F.struct(
        m["user_message"].alias("question"),
        F.coalesce(F.nullif(m["data_insights"], F.lit("")), F.substring(m["ai_response"], 1, summary)).alias("summary"),
        times.parse_iso(m["timestamp"]).alias("asked_at"))
    return convs.where(~F.col("deleted")).select("conv_id", F.transform(_last(F.col("messages"), n), entry).alias("context"))


def recorded_digest(convs: DataFrame, n: int = 3, cut: int = 100) -> DataFrame:
    """V3: text of the last ``n`` exchanges, each side cut, as the store keeps it next to a conversation."""
    side = lambda mark, c: F.concat(F.lit(mark), F.substring(F.coalesce(c, F.lit("")), 1, cut), F.lit("..."))
    text = lambda m: F.concat(side("Q: ", m["user_message"]), F.lit("\n"), side("A: ", m["ai_response"]))
    return convs.select("conv_id", F.array_join(F.transform(_last(F.col("messages"), n), text), "\n").alias("context_summary"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished run with its entries; times are UTC."""
    rows = _read(spark, path, RUN, "run_id")
    return rows.withColumns({
        "start_time": times.parse_iso(F.col("start_time")), "end_time": times.parse_iso(F.col("end_time")),
        "log_entries": F.coalesce("log_entries", F.array().cast(rows.schema["log_entries"].dataType))})


def recent_run_records(runs: DataFrame, n: int = 20, entries: int = 20) -> DataFrame:
    """The newest runs, each with its last entries in log order; ties by id."""
    newest = runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(n)
    return newest.withColumn("log_entries", _last(F.col("log_entries"), entries))


def entries_of(runs: DataFrame) -> DataFrame:
    """The entries of run records as rows, with their place in the run."""
    return runs.select("run_id", F.posexplode("log_entries").alias("place", "e")).select(
        "run_id", F.col("place").cast("bigint").alias("log_id"), times.parse_iso(F.col("e.timestamp")).alias("ts_utc"), "e.level", "e.stage",
        "e.message", "e.duration_ms")
