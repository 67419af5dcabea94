"""A stored hourly rollup of tickets: an exact, mergeable aggregate under the ticket reports.

A cell counts the tickets of one hour, owner, pipeline, weekend flag and response time; that is all that the
reports W1 to W6, W11 to W13, W15 to W17 and A7 read, medians included, as they count equal values first. Hours are
UTC, so a cell lies in one local day, week, quarter and named range under any zone of whole hours.

Cells add up: what a sync changes is a set of cells too, with counts below zero for the tickets as they were
before. ``RollupTable`` keeps the cells as plain Parquet in month folders; a sync rewrites the folders of the
months it touches (dynamic partition overwrite) and each folder names the last sync that it holds, so a sync that
is repeated after a failure, wherever it stopped, has no second effect.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators.distribution import WEIGHT
from caseload.operators.filters import ntz

MONTH = "create_month"
NO_MONTH = dt.date(1000, 1, 1)  # the folder of tickets without a time
KEYS = ["create_ts_utc", "create_ts_local", "case_owner", "pipeline", "is_weekend", "first_response_hours"]
SYNC = "sync_no"


def _hour(name: str):
    return F.date_trunc("hour", F.col(name).cast("timestamp")).cast("timestamp_ntz").alias(name)


def cells(tickets: DataFrame) -> DataFrame:
    """Cells of normalised tickets; with a column ``n_tickets`` rows count as often as it says."""
    counted = F.sum(WEIGHT) if WEIGHT in tickets.columns else F.count("*")
    hours = [_hour(k) if k.startswith("create_ts") else F.col(k) for k in KEYS]
    return tickets.groupBy(*hours).agg(counted.cast("long").alias(WEIGHT))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells of a sync: the changed tickets as they were stored, and as they are now.

    Both take the same filters as the rollup. A new ticket has no row in ``before``, a deleted one or one that a
    filter now drops none in ``after``.
    """
    weigh = lambda df, n: df.select(*KEYS, F.lit(n).cast("long").alias(WEIGHT))
    return cells(weigh(before, -1).unionByName(weigh(after, 1))).where(F.col(WEIGHT) != 0)


def _month():
    return F.coalesce(F.trunc(F.to_date("create_ts_utc"), "month"), F.lit(NO_MONTH)).alias(MONTH)


class RollupTable:
    """Cells in month folders below ``path``, with one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _put(self, df: DataFrame) -> None:
        """Replace the folders of the months in ``df``; cells lie in the order of time, so ranges skip row groups."""
        (df.hint("rebalance", MONTH).sortWithinPartitions(MONTH, "create_ts_utc").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(self.path))

    def build(self, tickets: DataFrame, sync_no: int = 0) -> None:
        """The cells of all tickets, as of a sync."""
        self._put(cells(tickets).select("*", _month(), F.lit(sync_no).cast("long").alias(SYNC)))

    def add(self, delta: DataFrame, sync_no: int) -> None:
        """Add the cells of ``change``; syncs have rising numbers, and a month that holds one already stays as it is.

        Cost follows the touched months. Cells that fall to zero stay in the folder, so that a month that has
        lost all its tickets is replaced too; readers don't see them.
        """
        delta = delta.select(*KEYS, WEIGHT, _month())
        months = [r[0] for r in delta.select(MONTH).distinct().collect()]
        if not months:
            return
        known = self._stored().where(F.col(MONTH).isin(months))
        held = known.groupBy(MONTH).agg(F.max(SYNC).alias("held"))
        new = delta.join(F.broadcast(held), MONTH, "left").where(F.coalesce("held", F.lit(-1)) < sync_no)
        due = [r[0] for r in new.select(MONTH).distinct().collect()]
        if not due:
            return
        both = known.where(F.col(MONTH).isin(due)).select(*KEYS, WEIGHT, MONTH).unionByName(
            new.select(*KEYS, WEIGHT, MONTH))
        merged = both.groupBy(*KEYS, MONTH).agg(F.sum(WEIGHT).cast("long").alias(WEIGHT))
        self._put(merged.withColumn(SYNC, F.lit(sync_no).cast("long")))

    def read(self) -> DataFrame:
        """All cells, in place of normalised tickets for reports over whole hours."""
        return self._stored().where(F.col(WEIGHT) > 0).drop(SYNC)

    def read_until(self, tickets: DataFrame, as_of: dt.datetime) -> DataFrame:
        """The cells, with the stored tickets themselves for the hour in which a range ends.

        A range up to ``as_of`` then has the rows that it has on ``tickets``, whatever the minute.
        """
        start = as_of.replace(minute=0, second=0, microsecond=0)
        end = start + dt.timedelta(hours=1)
        ts = F.col("create_ts_utc")
        last = tickets.where((ts >= ntz(start)) & (ts < ntz(end)))
        if MONTH in tickets.columns:
            last = last.where(F.col(MONTH) == F.lit(start.date().replace(day=1)))
        last = last.select(*KEYS, F.lit(1).cast("long").alias(WEIGHT), _month())
        return self.read().where(ts.isNull() | (ts != ntz(start))).unionByName(last)
