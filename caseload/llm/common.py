"""Words, folds, stored tables and bounded broadcasts, as the operators of this subpackage use them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.session import scratch_path

UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = UPPER_AZ.lower()
LOWERED = bytes.maketrans(UPPER_AZ.encode(), LOWER_AZ.encode())
BLANK = re.compile(rb"[\x20\x09-\x0D]")
WORD = r"[^\x20\x09-\x0D]+"
SPAN = 1 << 20  # bytes of text whose words are held as Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine gets the same text."""
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(parts)


def source_key(source: Column) -> Column:
    """A text that is never null, apart for the null source and for every other one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def word_runs(data: bytes, span: int = SPAN) -> Iterator[list[bytes]]:
    """The blank-separated words of a text in order, about ``span`` bytes at a time."""
    at = 0
    while at < len(data):
        end = at + span
        if end < len(data):
            hit = BLANK.search(data, end)
            end = hit.start() if hit else len(data)
        yield data[at:end].split()
        at = end


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, one row at a time."""
    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        yield value.as_py()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` below the shared folder and read it again: later jobs don't depend on executors.

    The files go when the driver's JVM ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
