"""Canonical tables and the mapping of physical column names to them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload import dims
from caseload.functions import times, values

# Fixed values. Logical column -> physical names, first one present wins.
TICKET_COLUMNS = {
    "ticket_id": ["Ticket ID", "Ticket number", "ID", "ticket_id"],
    "subject": ["Subject", "subject"],
    "description": ["Description", "content", "description"],
    "pipeline": ["Pipeline", "hs_pipeline", "pipeline"],
    "pipeline_stage": ["Pipeline Stage", "hs_pipeline_stage", "pipeline_stage"],
    "priority": ["Priority", "hs_ticket_priority", "priority"],
    "ticket_owner": ["Ticket owner", "Case Owner", "Owner", "Assigned Agent", "hubspot_owner_id",
                     "ticket_owner", "case_owner"],
    "create_ts": ["Create date", "createdate", "create_date", "created_at"],
    "close_ts": ["Close date", "closed_date", "close_date"],
    "last_modified_ts": ["Last Modified Date", "hs_lastmodifieddate", "last_modified_date",
                         "updated_at"],
    "first_response_ts": ["First agent email response date", "first_agent_reply_date",
                          "first_agent_response_date"],
    "last_activity_ts": ["Last activity date"],
    "last_closed_ts": ["Last Closed Date"],
    "last_contacted_ts": ["Last contacted date"],
    "last_customer_reply_ts": ["Last customer reply date"],
    "owner_assigned_ts": ["Owner assigned date"],
    "last_message_received_ts": ["Last message received date"],
    "last_response_ts": ["Last response date"],
    "reply_hms": ["Time to first agent email reply (HH:mm:ss)", "reply_hms"],
}

CHAT_COLUMNS = {
    "chat_id": ["chat_id", "id"],
    "created_raw": ["chat creation date America/Moncton", "chat creation date America/Halifax",
                    "chat creation date UTC", "chat_creation_date_adt", "chat_creation_date_utc",
                    "chat_creation_date", "created_ts_utc"],
    "created_utc": ["chat_creation_date_utc"],
    "created_iso": ["chat_created_at_iso"],
    "created_plain": ["chat_creation_date"],
    "started_raw": ["chat start date America/Moncton", "chat start date America/Halifax",
                    "chat start date UTC", "chat_start_date"],
    "primary_agent_raw": ["operator 1 nick", "primary_agent", "primary_agent_raw"],
    "secondary_agent_raw": ["operator 2 nick", "secondary_agent", "human_agents",
                            "secondary_agent_raw"],
    "human_agents": ["human_agents"],
    "rate_raw": ["rate", "rating_value", "rate_raw"],
    "duration_raw": ["chat duration in seconds", "duration_seconds", "duration_minutes",
                     "duration_raw"],
    "first_response_raw": ["first response time", "first_response_time", "first_response_raw",
                           "first_response_seconds"],
    "avg_response_raw": ["average response time", "avg_response_time", "avg_response_raw"],
    "country": ["visitor country code", "country"],
    "tag1": ["tag 1", "tag1", "tags"],
    "tag2": ["tag 2", "tag2"],
}

# Fixed values. API and store names -> file names of the ticket table.
API_TO_FILE = {
    "subject": "Subject",
    "hs_pipeline": "Pipeline",
    "hs_pipeline_stage": "Pipeline Stage",
    "createdate": "Create date",
    "hs_lastmodifieddate": "Last Modified Date",
    "closed_date": "Close date",
    "hubspot_owner_id": "Case Owner",
    "first_agent_reply_date": "First agent email response date",
    "hs_ticket_priority": "Priority",
    "content": "Description",
    "ticket_id": "Ticket ID",
}
FILE_TO_STORE = {
    "Ticket ID": "ticket_id",
    "Subject": "subject",
    "Pipeline": "pipeline",
    "Pipeline Stage": "pipeline_stage",
    "Create date": "create_date",
    "Last Modified Date": "last_modified_date",
    "Close date": "close_date",
    "First agent email response date": "first_agent_response_date",
    "first_agent_reply_date": "first_agent_response_date",
    "Case Owner": "case_owner",
    "Ticket owner": "case_owner",
    "Priority": "priority",
    "Description": "description",
    "First Response Time (Hours)": "first_response_hours",
    "Weekend_Ticket": "is_weekend",
}

# Fixed values. Columns that each report needs.
TICKET_REQUIREMENTS = {
    "weekly_response_breakdown": ["create_ts_local", "first_response_hours", "is_weekend"],
    "agent_ticket_volume_distribution": ["case_owner", "is_weekend"],
    "agent_response_time_comparison": ["case_owner", "first_response_hours", "pipeline"],
    "pipeline_distribution_by_agent": ["case_owner", "pipeline"],
    "pipeline_response_time_heatmap": ["case_owner", "pipeline", "first_response_hours"],
}
CHAT_REQUIREMENTS = {
    "daily_chat_trends_performance": ["created_ts_local", "rating_value", "bot_transfer"],
    "chat_weekly_volume_breakdown": ["created_ts_local", "agent_type"],
    "bot_volume_duration": ["agent_type", "display_agent", "duration_minutes"],
    "human_volume_duration": ["agent_type", "human_agents", "duration_minutes"],
}

AGENT_ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType())])
CHAT_EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("author_type", T.StringType())])
CHAT_PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("last_event_created_at", T.StringType()),
    T.StructField("users", T.ArrayType(AGENT_ENTRY)),
    T.StructField("thread", T.StructType([
        T.StructField("created_at", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("last_event_created_at", T.StringType()),
        T.StructField("events", T.ArrayType(CHAT_EVENT))])),
    T.StructField("properties", T.StructType([
        T.StructField("rating", T.StructType([
            T.StructField("score", T.DoubleType()), T.StructField("comment", T.StringType())])),
        T.StructField("source", T.StructType([T.StructField("type", T.StringType())]))])),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
TICKET_PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
DAILY_RATINGS = T.MapType(T.DateType(), T.StructType([
    T.StructField("good", T.LongType()), T.StructField("bad", T.LongType())]))


def physical(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_columns(df: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """Project the first present physical column for each logical one, NULL when none is."""
    present = set(df.columns)
    out = []
    for logical, names in spec.items():
        found = next((n for n in names if n in present), None)
        if found is None:
            out.append(F.lit(None).cast("string").alias(logical))
        elif logical == "duration_raw" and found == "duration_minutes":
            seconds = physical(found).cast("string").try_cast("double") * 60
            out.append(seconds.cast("string").alias(logical))
        else:
            out.append(physical(found).alias(logical))
    return df.select(*out)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns that are present. A target already present or taken is left alone."""
    taken = set(df.columns)
    out = []
    for name in df.columns:
        target = mapping.get(name, name)
        if target != name and target in taken:
            target = name
        taken.add(target)
        out.append(physical(name).alias(target))
    return df.select(*out)


def snake_name(name: str) -> str:
    return re.sub(r"[()]", "", name.lower().replace(" ", "_"))


def to_store_names(df: DataFrame) -> DataFrame:
    """File names to the snake-case names of the store."""
    named = rename(df, FILE_TO_STORE)
    return rename(named, {c: snake_name(c) for c in named.columns})


def to_file_names(df: DataFrame) -> DataFrame:
    """Store or API names back to file names."""
    back = {store: name for name, store in reversed(FILE_TO_STORE.items())}
    return rename(df, {**back, **API_TO_FILE})


def apply_types(
    df: DataFrame, dates: list[str] = (), numbers: list[str] = (), booleans: list[str] = (),
) -> DataFrame:
    """Types for a table that was read back as text; what does not parse becomes NULL."""
    present = set(df.columns)
    out = {c: times.parse_utc(physical(c)) for c in dates if c in present}
    out |= {c: values.number(physical(c)) for c in numbers if c in present}
    out |= {c: physical(c).try_cast("boolean") for c in booleans if c in present}
    return df.withColumns(out)


def ensure_ticket_columns(df: DataFrame) -> DataFrame:
    """Columns the ticket reports need, added with their rule when missing."""
    add = {}
    if "create_ts_local" not in df.columns and "create_ts_utc" in df.columns:
        add["create_ts_local"] = times.to_zone(F.col("create_ts_utc"), times.EASTERN)
    out = df.withColumns(add)
    add = {}
    if "is_weekend" not in out.columns and "create_ts_local" in out.columns:
        add["is_weekend"] = times.desk_weekend(F.col("create_ts_local"))
    if "first_response_hours" in out.columns:
        add["first_response_hours"] = F.col("first_response_hours").try_cast("double")
    return out.withColumns(add)


def ensure_chat_columns(df: DataFrame) -> DataFrame:
    """Columns the chat reports need, added with their rule when missing."""
    out = df
    if "rating_value" not in out.columns and "rate_raw" in out.columns:
        out = out.withColumn("rating_value", values.rating(F.col("rate_raw")))
    if "has_rating" not in out.columns and "rating_value" in out.columns:
        out = out.withColumn("has_rating", F.col("rating_value").isNotNull())
    if "bot_transfer" in out.columns:
        flag = F.coalesce(F.col("bot_transfer").try_cast("boolean"), F.lit(True))
        out = out.withColumn("bot_transfer", flag)
    if "duration_minutes" in out.columns:
        out = out.withColumn("duration_minutes", F.col("duration_minutes").try_cast("double"))
    if "agent_type" not in out.columns and "display_agent" in out.columns:
        kind = values.agent_type_by_word(F.col("display_agent"), dims.REPAIR_BOT_WORDS)
        out = out.withColumn("agent_type", kind)
    return out
