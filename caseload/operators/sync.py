"""Upserts, retention, incremental slices and sync state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators.filters import ntz
from caseload.operators.joins import dedup

DEFAULT_LOOKBACK_DAYS = 365
ALWAYS_WRITTEN = ("rate_raw",)


def ordered(df: DataFrame, name: str) -> Column:
    """A column as a part of an order; maps and variants count as their JSON text."""
    plain = df.schema[name].dataType.typeName() not in ("map", "variant")
    return F.col(f"`{name}`") if plain else F.to_json(f"`{name}`").alias(name)


def collapse_delta(delta: DataFrame, key: str, seq: str | None, always: tuple[str, ...] = ALWAYS_WRITTEN) -> DataFrame:
    """One row per key: the latest value present of each column.

    Columns in ``always`` take the latest value even when it is missing, stored as empty text. Without
    ``seq``, and among equal values of it, the greatest row in the order of all columns is the latest.
    """
    cols = [c for c in delta.columns if c not in (key, seq)]
    rank = F.struct(*([seq] if seq else []), *[ordered(delta, c) for c in cols])
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), rank))
    return delta.groupBy(key).agg(*[
        F.coalesce(F.max_by(c, rank), F.lit("")).alias(c) if c in always else latest(c).alias(c)
        for c in cols])


def _new_rows(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Delta rows whose key the base lacks. Only the key column of the base is read, and it is
    reduced to keys of the delta first, so a small delta never makes the base shuffle."""
    same = F.col("_known").eqNullSafe(F.col("_changed"))
    known = base.select(F.col(key).alias("_known")).join(delta.select(F.col(key).alias("_changed")), same, "left_semi")
    return delta.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def upsert_merge(base: DataFrame, delta: DataFrame, key: str, seq: str | None = None,
                 always: tuple[str, ...] = ALWAYS_WRITTEN) -> DataFrame:
    """Present fields of the delta overwrite, all others are kept; new keys are added.

    ``seq`` orders several delta rows of one key. The key is unique in ``base``; a missing one is a key like any other.
    """
    one = collapse_delta(delta, key, seq, always)
    fields = [c for c in one.columns if c != key]
    incoming = one.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = base.join(incoming, F.col(key).eqNullSafe(F.col("_key")), "left")
    merged = lambda c: (F.coalesce(f"_new_{c}", c) if c in base.columns else F.col(f"_new_{c}")).alias(c)
    kept = [merged(c) if c in fields else F.col(c) for c in base.columns]
    updated = joined.select(*kept, *[merged(c) for c in fields if c not in base.columns])
    return updated.unionByName(_new_rows(base, one, key), allowMissingColumns=True)


def latest_rows(delta: DataFrame, key: str, seq: str | None) -> DataFrame:
    """One row per key: the latest by ``seq``, then by all columns, so the result doesn't depend on partitions."""
    others = [ordered(delta, c).desc() for c in delta.columns if c not in (key, seq)]
    one = dedup(delta, key, [*([F.desc(seq)] if seq else []), *others])
    return one.drop(seq) if seq else one


def upsert_replace(base: DataFrame, delta: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """The latest delta row of a key replaces the whole base row; new keys are added."""
    latest = latest_rows(delta, key, seq)
    untouched = base.join(
        latest.select(F.col(key).alias("_changed")), F.col(key).eqNullSafe(F.col("_changed")), "left_anti").select(*base.columns)
    return untouched.unionByName(latest, allowMissingColumns=True)


def is_older(ts: str, days: int, as_of: dt.datetime):
    return F.coalesce(F.col(ts) < ntz(as_of - dt.timedelta(days=days)), F.lit(False))


def retain(df: DataFrame, ts: str, days: int, as_of: dt.datetime) -> DataFrame:
    """Drop rows older than ``days``; rows without a time stay."""
    return df.where(~is_older(ts, days, as_of))


def incremental(df: DataFrame, last_sync: dt.datetime | None, as_of: dt.datetime, full: bool = False,
                ts: str = "last_modified_ts_utc") -> DataFrame:
    """U4: rows modified since the last sync; without a state, or for a full sync, the last 365 days."""
    since = last_sync if last_sync and not full else as_of - dt.timedelta(days=DEFAULT_LOOKBACK_DAYS)
    return df.where(F.col(ts) >= ntz(since))


STATE_SCHEMA = "feed string, last_sync timestamp_ntz, records bigint, status string, updated_at timestamp_ntz"


def state_row(spark: SparkSession, feed: str, last_sync: dt.datetime, records: int, status: str,
              updated_at: dt.datetime) -> DataFrame:
    return spark.createDataFrame([(feed, last_sync, records, status, updated_at)], STATE_SCHEMA)


def save_state(state: DataFrame, row: DataFrame) -> DataFrame:
    """Field-merge of one feed's state into the state table, by one aggregation and no join."""
    both = state.withColumn("_seq", F.lit(0)).unionByName(row.withColumn("_seq", F.lit(1)))
    return collapse_delta(both, "feed", "_seq", always=()).select(*state.columns)


def load_state(state: DataFrame, feed: str, as_of: dt.datetime) -> dt.datetime:
    """Last sync of a feed, one year before ``as_of`` when there is none."""
    row = state.where(F.col("feed") == feed).agg(F.max("last_sync").alias("t")).first()
    return row["t"] or as_of - dt.timedelta(days=DEFAULT_LOOKBACK_DAYS)


def feed_state(df: DataFrame, feed: str, ts: str, as_of: dt.datetime, status: str = "success") -> DataFrame:
    """The state a sync leaves behind, taken from the synced rows themselves."""
    return df.agg(
        F.lit(feed).alias("feed"), F.max(ts).alias("last_sync"), F.count("*").alias("records"),
        F.lit(status).alias("status"), ntz(as_of).alias("updated_at"))


def refresh_metadata(tickets: DataFrame, chats: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The counts written next to a full refresh."""
    rows = lambda df, name: df.agg(F.lit(name).alias("table_name"), F.count("*").alias("records"))
    both = rows(tickets, "tickets").unionByName(rows(chats, "chats"))
    return both.withColumn("last_updated", ntz(as_of))
