"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node to the smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours to the smallest of them; ``a`` is the larger end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        .union(joined.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest node it reaches.

    Roots are listed as well. Links are shuffled and aggregated, never gathered: a node with very many
    neighbours is a minimum per key and a join that Spark can split. Every round is written to the shared
    folder and the one before is removed. Loops and nulls are left out; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stored(start, "links")
    seen = None
    while True:
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == seen or not total[0]:
            break
        seen, old = total, path
        now, path = stored(_small_star(_large_star(now)), "links")
        discard(spark, old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
