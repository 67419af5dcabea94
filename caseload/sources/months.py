"""Keyed tables as plain Parquet in month folders, changed by dynamic partition overwrite.

A change first writes the new content of the months it touches to a redo folder below the table, then replaces
those months. Whoever opens the table next finishes a change that stopped between the two, so a lost driver
leaves each change either undone or done, and a change that is repeated has no second effect. Where keys never
change their month, an upsert needs no redo folder: done again, it gives every month the same rows. One writer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import sync

FOLDER = "month_folder"
Batch = tuple[str, int]


def _folder(value: Column) -> Column:
    """A folder name that needs no escaping and is never taken for a number; the column itself stays as it is."""
    return F.concat(F.lit("m"), F.coalesce(F.hex(value.cast("string")), F.lit("-")))


class MonthTable:
    """A table with one folder per value of ``month``.

    ``fixed`` says that a key never changes its month and every change carries it: then only the months named in a
    change are read. Otherwise the key column of all months is read to find where changed keys lie.
    """

    def __init__(self, spark: SparkSession, path: str, month: str = "month", fixed: bool = False):
        self.spark, self.path, self.month, self.fixed = spark, path.rstrip("/"), month, fixed
        self._conf = spark._jsc.hadoopConfiguration()

    def _where(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._where("rows").getFileSystem(self._conf)

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._where(name))

    def _delete(self, name: str) -> None:
        self._fs().delete(self._where(name), True)

    def _finish(self) -> None:
        """Finish a change that was left behind."""
        if self._exists("redo/touched/_SUCCESS"):
            self._apply()

    def _open(self) -> DataFrame | None:
        """All months with the folder column."""
        self._finish()
        if not self._exists("rows"):
            return None
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/rows")
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no month is left
                raise
            return None

    def read(self) -> DataFrame | None:
        rows = self._open()
        return None if rows is None else rows.drop(FOLDER)

    def _change(self, rows: DataFrame, touched: DataFrame | list[str], batch: Batch | None) -> None:
        """``rows`` become the content of the touched months."""
        self._delete("redo")
        named = rows.withColumn(FOLDER, _folder(F.col(self.month)))
        named.hint("rebalance", FOLDER).write.partitionBy(FOLDER).parquet(f"{self.path}/redo/rows")
        feed, number = batch or (None, None)
        if not isinstance(touched, DataFrame):
            touched = self.spark.createDataFrame([(t,) for t in touched], f"{FOLDER} string")
        marks = touched.select(FOLDER).distinct().withColumns({
            "feed": F.lit(feed).cast("string"), "number": F.lit(number).cast("long")})
        none = self.spark.createDataFrame([(None, feed, number)], f"{FOLDER} string, feed string, number long")
        marks.union(none).write.parquet(f"{self.path}/redo/touched")  # complete with its _SUCCESS file
        self._apply()

    def _put(self, rows: DataFrame) -> None:
        """The rows become the whole content of their months."""
        (rows.withColumn(FOLDER, _folder(F.col(self.month))).hint("rebalance", FOLDER).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(f"{self.path}/rows"))

    def _done(self, batch: Batch | None) -> None:
        if batch:
            feed, number = batch
            row = self.spark.createDataFrame([(feed, number)], "feed string, number long")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/{feed.encode().hex()}")

    def _apply(self) -> None:
        marks = self.spark.read.parquet(f"{self.path}/redo/touched").collect()  # one row per touched month
        try:
            rows = self.spark.read.parquet(f"{self.path}/redo/rows")
        except AnalysisException as e:
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            rows = None
        kept = set()
        if rows is not None:
            kept = {r[0] for r in rows.select(FOLDER).distinct().collect()}
            self._put(rows.drop(FOLDER))
        for name in {m[FOLDER] for m in marks} - kept - {None}:
            self._delete(f"rows/{FOLDER}={name}")
        feed, number = marks[0]["feed"], marks[0]["number"]
        self._done((feed, number) if feed is not None else None)
        self._delete("redo")

    def has_batch(self, batch: Batch | None) -> bool:
        """Whether a micro-batch of a feed, whose numbers rise, is already part of the table."""
        if not batch:
            return False
        self._finish()
        name = f"done/{batch[0].encode().hex()}"
        if not self._exists(f"{name}/_SUCCESS"):
            return False
        return self.spark.read.parquet(f"{self.path}/{name}").first()["number"] >= batch[1]

    def write(self, df: DataFrame, batch: Batch | None = None) -> None:
        """Replace the whole table."""
        old = self._open()
        self._change(df, [] if old is None else old.select(FOLDER), batch)

    def _upsert(self, delta: DataFrame, key: str, apply, batch: Batch | None) -> None:
        if self.has_batch(batch):
            return
        rows = self._open()
        if rows is None:
            self._change(delta, [], batch)
            return
        folder = _folder(F.col(self.month)).alias(FOLDER)
        touched = delta.select(folder) if self.month in delta.columns else None
        if not self.fixed or touched is None:
            known = rows.select(key, FOLDER).alias("r").join(
                delta.select(F.col(key).alias("_changed")), F.col(key).eqNullSafe(F.col("_changed")), "left_semi").select(FOLDER)
            touched = known if touched is None else touched.union(known)
        names = [r[0] for r in touched.distinct().collect()]  # at most all months
        new = apply(rows.where(F.col(FOLDER).isin(names)).drop(FOLDER), delta, key)
        if not self.fixed:
            self._change(new, names, batch)
        elif names:  # done again after a failure, the same change gives every month the same rows
            self._put(new)
        if self.fixed:
            self._done(batch)

    def merge(self, delta: DataFrame, key: str, seq: str | None = None, batch: Batch | None = None) -> None:
        """U1 into the stored table. A batch that is already part of it is skipped."""
        self._upsert(sync.collapse_delta(delta, key, seq), key, sync.upsert_merge, batch)

    def replace(self, delta: DataFrame, key: str, seq: str | None = None, batch: Batch | None = None) -> None:
        """U2 into the stored table. A batch that is already part of it is skipped."""
        self._upsert(sync.latest_rows(delta, key, seq), key, sync.upsert_replace, batch)

    def retain(self, ts: str, days: int, as_of: dt.datetime) -> None:
        """U3, L3 on the stored table: months that are old as a whole are dropped, only border months are rewritten."""
        rows = self._open()
        if rows is None:
            return
        old = sync.is_older(ts, days, as_of)
        counts = rows.groupBy(FOLDER).agg(F.count("*").alias("n"), F.count_if(old).alias("old")).where("old > 0").collect()
        border = [r[FOLDER] for r in counts if r["old"] < r["n"]]
        self._change(sync.retain(rows.where(F.col(FOLDER).isin(border)).drop(FOLDER), ts, days, as_of), [r[FOLDER] for r in counts], None)
