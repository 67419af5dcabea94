"""Chat normalisation: zones, agents, ratings, transfers, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload import dims
from caseload.functions import times, values
from caseload.operators.joins import dedup


def _parsed(df: DataFrame, names: list[str]):
    cols = [n for n in names if n in df.columns]
    if not cols:
        return F.lit(None).cast("timestamp_ntz")
    text = lambda n: df.schema[n].dataType == T.StringType()
    return F.coalesce(*[times.parse_utc(F.col(n)) if text(n) else F.col(n) for n in cols])


def chat_tz(df: DataFrame) -> DataFrame:
    """First creation (and start) candidate that parses, in UTC, as ISO text and in Atlantic time."""
    out = df.withColumns({
        "created_ts_utc": _parsed(
            df, ["created_raw", "created_utc", "created_iso", "created_plain", "created_ts_utc"]),
        "started_ts_utc": _parsed(df, ["started_raw", "started_ts_utc"]),
    })
    return out.withColumns({
        "created_iso": times.iso_utc(F.col("created_ts_utc")),
        "started_iso": times.iso_utc(F.col("started_ts_utc")),
        "created_ts_local": times.to_zone(F.col("created_ts_utc"), times.ATLANTIC),
        "started_ts_local": times.to_zone(F.col("started_ts_utc"), times.ATLANTIC),
    }).drop("created_raw", "created_utc", "created_plain", "started_raw")


def chat_date_parts(df: DataFrame) -> DataFrame:
    """N7."""
    local = F.col("created_ts_local")
    return df.withColumns({
        "date": F.to_date(local),
        "hour": F.hour(local),
        "day_of_week": F.date_format(local, "EEEE"),
    })


def classify_agent(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """N17, with the missing names filled: ``Unknown`` for primary, empty for secondary."""
    return df.withColumns({
        "primary_agent": F.coalesce("primary_agent_raw", F.lit("Unknown")),
        "secondary_agent": F.coalesce("secondary_agent_raw", F.lit("")),
    }).withColumn("agent_type", values.agent_type(F.col("primary_agent"), agents))


def display_agent(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """Bot name, then human name, else the name itself."""
    return df.withColumn("display_agent", values.agent_display(F.col("primary_agent"), agents))


def classify_by_keyword(df: DataFrame, col: str, words: list[str] = dims.METRIC_BOT_WORDS,
                        name: str = "agent_type") -> DataFrame:
    """Bot or human by substring, used where no registry match is possible."""
    return df.withColumn(name, values.agent_type_by_word(F.col(col), words))


def normalize_rating(df: DataFrame) -> DataFrame:
    """N20."""
    return df.withColumn("rating_value", values.rating(F.col("rate_raw"))).withColumn(
        "has_rating", F.col("rating_value").isNotNull())


def score_to_text(df: DataFrame, score: str = "score", name: str = "rate_raw") -> DataFrame:
    """N21."""
    return df.withColumn(name, values.score_text(F.col(score)))


def transfer_flag(df: DataFrame) -> DataFrame:
    """Transfer tag on the chat or a second agent."""
    tagged = (F.col("tag1") == dims.TRANSFER_TAG) | (F.col("tag2") == dims.TRANSFER_TAG)
    return df.withColumn(
        "bot_transfer", F.coalesce(tagged, F.lit(False)) | (F.col("secondary_agent") != ""))


def durations(df: DataFrame) -> DataFrame:
    """Numbers or 0; minutes from seconds."""
    return df.withColumns({
        "duration_seconds": values.number_or_zero(F.col("duration_raw")),
        "first_response_seconds": values.number_or_zero(F.col("first_response_raw")),
        "avg_response_seconds": values.number_or_zero(F.col("avg_response_raw")),
    }).withColumn("duration_minutes", F.col("duration_seconds") / 60)


def time_period(df: DataFrame, hour: str = "hour") -> DataFrame:
    """N27."""
    return df.withColumn("time_period", values.time_period(F.col(hour)))


def normalize_chats(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """N6, N7, N17, N18, N20, N22, N23."""
    out = display_agent(classify_agent(chat_date_parts(chat_tz(df)), agents), agents)
    return durations(transfer_flag(normalize_rating(out)))


def one_copy(df: DataFrame, key: str = "chat_id", ts: str = "created_ts_utc") -> DataFrame:
    """One row per chat, marked by the column ``first_copy``.

    The earliest copy counts; among copies of one time the smallest in the order of all columns by name, so
    every report on the table sees the same one, whatever columns it reads and however rows are partitioned.
    """
    others = sorted(c for c in df.columns if c not in (key, ts))
    plain = [F.to_json(f"`{c}`") if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in others]
    return dedup(df, key, [F.col(ts), *plain]).withColumn("first_copy", F.lit(True))
