"""F14 over a stored table: trigram postings name the rows that can hold a text.

Every text column of a row gives the trigrams of its lower-cased text, padded at the end, so that a query of one or
two characters is the beginning of a trigram wherever it stands. Postings lie in one folder per month, sorted by
trigram; a month is built once and again only when it has changed. What is shuffled are the rows, dealt out so that
every task makes and sorts the postings of about ``LETTERS`` letters and writes them as one file of a month. A search
reads the postings of its trigrams by their page bounds, keeps the keys that have all of them, and tests only those rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.operators import filters

PAD = "\x00\x00"
LETTERS = 1 << 21  # of the rows whose postings one task makes
MARKS = 60  # trigrams counted in one long
FOLDER = "month_folder"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType == T.StringType()]


def grams_of(query: str) -> list[str]:
    return sorted({query[i:i + 3] for i in range(len(query) - 2)})


def postings(df: DataFrame, key: str) -> DataFrame:
    """``gram, key``, once for every row that has the trigram in any text column."""
    texts = F.filter(F.array(*[F.lower(F.col(f"`{c}`")) for c in text_columns(df)]).cast("array<string>"), lambda t: t.isNotNull())
    letters = F.transform(texts, lambda t: F.split(F.concat(t, F.lit(PAD)), ""))  # code points
    grams = F.expr(
        "array_distinct(flatten(transform(letters, l -> "
        "transform(slice(l, 1, size(l) - 2), (c, i) -> concat(c, l[i + 1], l[i + 2])))))")
    return df.select(F.col(key).alias("key"), letters.alias("letters")).select(F.explode(grams).alias("gram"), "key")


class SearchIndex:
    """Postings of a table below ``path``; ``month`` names the column whose values are built one by one."""

    def __init__(self, spark: SparkSession, path: str, key: str = "ticket_id", month: str | None = None):
        self.spark, self.path, self.key, self.month = spark, path, key, month

    def build(self, df: DataFrame) -> None:
        """Postings of all rows of the months in ``df``, in place of what the index had for these months.

        A build that failed is done again; other months keep their files.
        """
        value = F.col(self.month).cast("string") if self.month else F.lit("all")
        folder = F.concat(F.lit("m"), F.coalesce(F.hex(value), F.lit("-")))
        texts = text_columns(df)
        letters = df.select(F.sum(sum((F.coalesce(F.length(f"`{c}`"), F.lit(0)) for c in texts), F.lit(0).cast("long")))).first()[0]
        parts = -(-(letters or 0) // LETTERS) or 1
        # Rows of one key, or without any, are told apart by their texts.
        dealt = df.withColumn("_folder", folder).repartitionByRange(
            parts, "_folder", self.key, F.xxhash64(*[F.col(f"`{c}`") for c in texts]) if texts else F.lit(0))
        named = dealt.select(F.struct(F.col(self.key), "_folder").alias("_row"), *texts)
        rows = postings(named, "_row").select("gram", F.col(f"key.{self.key}").alias("key"), F.col("key._folder").alias(FOLDER))
        (rows.sortWithinPartitions(FOLDER, "gram").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(self.path))

    def candidates(self, query: str) -> DataFrame:
        """``key`` of the rows that can hold the query, a superset of those that do."""
        rows = self.spark.read.parquet(self.path)
        needle = query.lower()
        if len(needle) < 3:
            return rows.where(F.col("gram").startswith(needle)).select("key").distinct()
        grams = grams_of(needle)
        # One bit per trigram, so that rows of a key combine before the shuffle.
        groups = [grams[i:i + MARKS] for i in range(0, len(grams), MARKS)]
        marks = [F.bit_or(F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << j).cast("long")) for j, g in enumerate(group)], F.lit(0).cast("long")))
                 .alias(f"g{i}") for i, group in enumerate(groups)]
        found = rows.where(F.col("gram").isin(grams)).groupBy("key").agg(*marks)
        return found.where(reduce(and_, [F.col(f"g{i}") == (1 << len(group)) - 1 for i, group in enumerate(groups)])).select("key")

    def search(self, df: DataFrame, query: str, limit: int = 10) -> DataFrame:
        """The rows that ``filters.search`` gives; ``df`` is the table that the index was built from."""
        if not query:
            return filters.search(df, query, limit, self.key)
        rows = df.join(self.candidates(query), F.col(self.key).eqNullSafe(F.col("key")), "left_semi")
        return filters.search(rows, query, limit, self.key)
