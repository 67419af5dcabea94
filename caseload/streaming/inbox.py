"""ST1 for an inbox whose files may be rewritten: content hashes by name decide what is read again.

A sync lists the inbox, hashes the files whose size or time differs from what it knows of them, and reads those
whose content is new. Rows and ledger lie in folders of the sync's number; the ledger is written last. A sync
that failed anywhere is done again under the same number and replaces what it had left behind.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import dims, schema
from caseload.sources.csv_scan import CsvScan
from caseload.sources.files import file_date

LEDGER = "sync_no long, file string, length long, changed timestamp, hash long, read_in long, reason string"
SYNC = "inbox_sync"
HASHED = 1 << 30  # bytes; the content of a larger file isn't held as one value, its size and time stand for it


class Inbox:
    """CSV files below ``source``, synced into ``target``; one sync at a time."""

    def __init__(self, spark: SparkSession, source: str, target: str):
        self.spark, self.source, self.target = spark, source, target.rstrip("/")

    def _read(self, name: str, **options) -> DataFrame | None:
        try:
            return self.spark.read.options(**options).parquet(f"{self.target}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def ledger(self) -> DataFrame:
        """The last entry of every file: its hash, the sync that read it, the reason if it was left out."""
        seen = self._read("ledger")
        if seen is None:
            return self.spark.createDataFrame([], LEDGER)
        last = F.max_by(F.struct(*[c for c in seen.columns if c not in ("file", SYNC)]), "sync_no")
        return seen.groupBy("file").agg(last.alias("e")).select("file", "e.*")

    def _listing(self, paths: list[str] | None, *more: Column) -> DataFrame:
        reader = self.spark.read.format("binaryFile")
        if paths is None:
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
        return reader.load(paths or self.source).select(
            F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("changed"), *more)

    def sync(self, ready_before: dt.datetime | None = None) -> int:
        """Read new and changed files; returns how many. Files that are gone keep their rows.

        Files changed after ``ready_before`` (UTC) are left to the next sync, as they may still be written to.
        """
        known = self.ledger()
        number = (known.agg(F.max("sync_no")).first()[0] or 0) + 1
        moved = self._listing(None, F.col("path")).join(known.select("file", "length", "changed"), ["file", "length", "changed"], "left_anti")
        if ready_before:
            moved = moved.where(F.col("changed") <= F.lit(ready_before.replace(tzinfo=dt.timezone.utc)))
        # The driver sees what has changed since the last sync, not the inbox.
        paths = {r["file"]: re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in moved.select("file", "path").collect()}
        if not paths:
            return 0
        content = F.when(F.col("length") <= HASHED, F.xxhash64("content")).otherwise(F.xxhash64("length", "modificationTime"))
        hashed = self._listing(list(paths.values()), content.alias("hash"))
        old = known.select("file", F.col("hash").alias("old"), "read_in", F.col("reason").alias("why"))
        same = F.col("old").eqNullSafe(F.col("hash"))
        entries = hashed.join(old, "file", "left").select(
            F.lit(number).cast("long").alias("sync_no"), "file", "length", "changed", "hash",
            F.when(same, F.col("read_in")).otherwise(F.lit(number)).cast("long").alias("read_in"),
            F.when(same, F.col("why")).alias("reason"))
        changed = [paths[r["file"]] for r in entries.where(F.col("read_in") == number).select("file").collect()]
        if changed:
            entries = self._store(changed, entries, number)
        entries.write.mode("overwrite").parquet(f"{self.target}/ledger/{SYNC}={number}")
        return len(changed)

    def _store(self, paths: list[str], entries: DataFrame, number: int) -> DataFrame:
        scan = CsvScan(self.spark, paths)
        if scan.rows is not None:
            text = lambda c: F.when(~c.isin(dims.NULL_TOKENS), c)
            rows = scan.rows.select(
                *[text(schema.physical(c)).alias(c) for c in scan.columns], F.col(scan.FILE).alias("source_file"),
                file_date(F.col(scan.FILE)).alias("file_date"))
            rows.write.mode("overwrite").parquet(f"{self.target}/rows/{SYNC}={number}")
        if scan.files is None:
            return entries
        bad = scan.files.where("reason is not null").select("file", F.col("reason").alias("bad"))
        return entries.join(bad, "file", "left").withColumn("reason", F.coalesce("reason", "bad")).drop("bad")

    def read(self) -> DataFrame:
        """The rows of every file's last content, as text, with its path and the date in its name.

        Columns of all headers so far; null where a file lacks one.
        """
        rows = self._read("rows", mergeSchema="true")
        if rows is None:
            raise ValueError("nothing has been synced")
        now = self.ledger().select(F.col("file").alias("source_file"), F.col("read_in").alias(SYNC))
        return rows.join(now, ["source_file", SYNC], "left_semi").drop(SYNC)
