"""Sharding by proportional stratified interleaving (operator 7), DataFrame functions only.

The rows of each source are shuffled by a seeded hash and ranked; the rank divided by the size of the
source is the fractional rank, and all rows sorted by it are cut into equal shards, so that every shard
has the sources in the proportions of the whole.

Ranks are not taken in one window: rows are dealt into cells (of the hash, then of the fractional rank),
the sizes of the cells are summed up in order, and a row's rank is that sum plus its place inside its
cell. A source or shard of any size is spread over many cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.llm.common import source_key

SHARDS = 40
SEED = 20_240_607
CELL_ROWS = 1_000


def _before(counts: DataFrame, cell: str, by: list[str], name: str) -> DataFrame:
    """Rows in the cells before each one."""
    order = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")))


def interleave(rows: DataFrame, key: list[str], source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``row, shard, slot``: every row with its shard and its gapless place in it.

    ``key`` names the columns that order the rows of a source after hashing; rows equal in them are
    interchangeable. Shard sizes differ by at most one row. A null source is a source of its own. An empty
    table gives an empty table.
    """
    total = rows.count()
    cells = max(1, math.ceil(total / max(CELL_ROWS, math.isqrt(total))))
    mark = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in key])
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), source_key(F.col(f"`{source}`")).alias("src"),
        mark.alias("mark")).withColumn("cell", F.pmod(F.shiftrightunsigned("mark", 16), F.lit(cells)))
    counts = packed.groupBy("src", "cell").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("src").agg(F.sum("n").alias("size"))
    starts = _before(counts, "cell", ["src"], "start").join(sizes, "src").select("src", "cell", "start", "size")
    place = F.row_number().over(Window.partitionBy("src", "cell").orderBy("mark"))
    ranked = (
        packed.join(starts, ["src", "cell"]).withColumn("rank", F.col("start") + place)
        .withColumn("part", (F.col("rank") - 0.5) / F.col("size"))
        .withColumn("slice", F.least(F.floor(F.col("part") * cells), F.lit(cells - 1))))
    slices = _before(ranked.groupBy("slice").agg(F.count("*").alias("n")), "slice", [], "start")
    tie = F.xxhash64(F.lit(seed), F.col("src"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("part", tie, "src"))
    n, k = F.lit(max(total, 1)), F.lit(shards)
    at = F.col("start") + inside - 1
    return (
        ranked.drop("start", "size", "cell", "rank").join(slices.select("slice", "start"), "slice")
        .withColumn("at", at)
        .withColumn("shard", F.expr(f"`at` * {shards} div {max(total, 1)}"))
        .select("row", F.col("shard").cast("int").alias("shard"),
                (F.col("at") - F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")).alias("slot")))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with all their columns, and ``shard`` and ``slot`` (in place of columns of these names)."""
    out = interleave(docs, ["doc_id", "text"], shards=shards)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return out.select(*kept, "shard", "slot")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns; the law is ``rows``. A null text has no bytes and the checksum of no bytes."""
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"))
    out = interleave(light, ["doc_id", "text_crc32", "size"], shards=shards)
    return out.select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
