"""Structured Streaming feeds: new files, continuous upsert, duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import dims
from caseload.sources.files import file_date
from caseload.sources.months import MonthTable


def stream_files(spark: SparkSession, path: str, columns: list[str], max_files: int = 100,
                 multi_line: bool = True) -> DataFrame:
    """ST1: every new CSV file once, as text, with its path and the date in its name.

    The checkpoint remembers the files seen; changed content arrives under a new path (``Inbox`` reads rewritten
    files and other headers). ``multi_line=False`` splits large files that have no line breaks in cells.
    """
    shape = ", ".join(f"`{c}` string" for c in columns)
    feed = (
        spark.readStream.schema(shape).option("header", "true").option("multiLine", multi_line)
        .option("escape", '"').option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path))
    text = lambda c: F.when(~F.col(f"`{c}`").isin(dims.NULL_TOKENS), F.col(f"`{c}`")).alias(c)
    source = F.col("_metadata.file_path")
    return feed.select(*[text(c) for c in columns], source.alias("source_file"),
                       file_date(source).alias("file_date"))


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what is there now to a Parquet table and stop."""
    (stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def stream_upsert(stream: DataFrame, table: MonthTable, key: str, checkpoint: str,
                  seq: str | None = None, replace: bool = False) -> None:
    """ST3: merge every micro-batch into the keyed table and stop when the input is drained.

    A micro-batch rewrites the months that it touches. The table knows the last batch of the feed, so a batch
    replayed after a failure has no second effect.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (table.replace if replace else table.merge)(batch, key, seq, (checkpoint, batch_id))

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedup(stream: DataFrame, target: str, checkpoint: str, key: str = "chat_id") -> None:
    """ST4: add the first arrival of every key to a Parquet table, however late, and stop when the input is drained.

    The keys seen lie in the stream's keyed state, on the executors' disks and in the checkpoint, so the work of
    a micro-batch follows its own rows and not the life of the feed. Rows without a key count as one key; of several
    copies in one micro-batch one stays. The rows of a micro-batch lie in a folder of its number, which a replay
    overwrites, so it has no second effect. ``read_deduped`` reads the target, which belongs to one checkpoint.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        (stream.dropDuplicates([key]).writeStream
         .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}"))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(STATE_STORE, before)


def read_deduped(spark: SparkSession, target: str) -> DataFrame:
    """The table that ``stream_dedup`` fills: one row per key."""
    return spark.read.parquet(target).drop("batch")
