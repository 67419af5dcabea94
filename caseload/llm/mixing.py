"""Mixing sources to target weights (operator 3).

The words of a source form one stream, document after document in a seeded order, packed into blocks of
``BLOCK`` words that run over document borders. Each source gets slots until its target is met: for every
output shard a multinomial draw says how many; the slots of a source, numbered over the shards, are mapped
through a pseudorandom permutation of its block numbers (a new one for each pass over the source), and the
blocks are joined by number. The last slot of a source takes only the words still due.

Places in a stream are running sums over cells of documents, so a source of any size is spread over many
tasks. Texts are moved once, and only by ``mixed_documents``.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.common import WORD, source_key, stored

BLOCK = 512
SHARD_BLOCKS = 1024
SEED = 20_240_611
MOST = 3  # passes over a source
CELL_ROWS = 1_000
ROUNDS = 4
WORDS = re.compile(WORD)


# A permutation of 0..n-1 for each key: a Feistel network over the next even number of bits, walked on
# until the value lies below n.

def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _walk(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [zlib.crc32(f"{key}:{i}".encode()) for i in range(ROUNDS)]
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    return _walk(x, n, key, back=False)


def unpermute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    return _walk(x, n, key, back=True)


def pass_key(src: str, epoch: int, seed: int) -> int:
    return zlib.crc32(f"{seed}/{epoch}/{src}".encode("utf-8", "surrogatepass"))


def slots_due(src: str, size: int, due: int, block: int, seed: int) -> tuple[int, int]:
    """How many slots give ``due`` words of a stream of ``size``, and the words the last one takes."""
    if not due:
        return 0, 0
    blocks = -(-size // block)
    full, rest = divmod(due, size)
    short = size - (blocks - 1) * block
    if not rest:  # whole passes end on the block at the last place
        at = int(unpermute(np.array([blocks - 1]), blocks, pass_key(src, full - 1, seed))[0])
        return full * blocks, short if at == blocks - 1 else block
    at = int(unpermute(np.array([blocks - 1]), blocks, pass_key(src, full, seed))[0])
    if rest <= at * block:
        n = -(-rest // block)
        return full * blocks + n, rest - (n - 1) * block
    if rest <= at * block + short:
        return full * blocks + at + 1, rest - at * block
    rest += block - short
    n = -(-rest // block)
    return full * blocks + n, rest - (n - 1) * block


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to ``sizes(src, source, source_size)``, one row per source.

    Sources by code point, null last, weigh 1, 2, 3 and so on in turn and share the words of all; a target
    ends at ``MOST`` times the source's size and the excess goes to the others by weight. In order of size
    by weight the full ones come first, so one running sum finds the share of the rest.
    """
    every = Window.partitionBy()
    weighed = sizes.withColumn(
        "weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("room", (F.col("source_size") * MOST).cast("double")).withColumn(
        "level", F.col("room") / F.col("weight"))
    order = Window.orderBy("level", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    shared = weighed.withColumn(
        "share", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        / F.sum("weight").over(after))
    final = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "src", "share"))).over(every)["share"]
    return shared.withColumn("final", final).select(
        "src", "source", "source_size", F.least("room", F.col("final") * F.col("weight")).alias("target"),
        F.sum("source_size").over(every).alias("total"))


def _keys() -> list[Column]:
    """Two 64-bit keys that tell different documents apart."""
    src, text, doc = source_key(F.col("source")), F.col("text").cast("string"), F.col("doc_id").cast("long")
    return [F.xxhash64(doc.isNull(), doc, src, text.isNull(), text).alias("k1"), F.xxhash64(F.lit(7), text, src, doc).alias("k2")]


def _light(docs: DataFrame) -> DataFrame:
    """The keys and the size in words of every row."""
    text = F.col("text").cast("string")
    return docs.select(
        *_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        source_key(F.col("source")).alias("src"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _placed(light: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``, the place of the first word in the stream of the source."""
    rows = light.count()
    cells = max(1, math.ceil(rows / max(CELL_ROWS, math.isqrt(rows))))
    mark = F.xxhash64(F.lit(seed), F.col("k1"), F.col("k2"))
    words = F.col("size") * F.col("copies")
    dealt = light.withColumn("mark", mark).withColumn("cell", F.pmod(F.shiftrightunsigned("mark", 16), F.lit(cells)))
    sums = dealt.groupBy("src", "cell").agg(F.sum(words).alias("n"))
    prior = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "cell", F.coalesce(F.sum("n").over(prior), F.lit(0).cast("long")).alias("base"))
    inside = Window.partitionBy("src", "cell").orderBy("mark", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, ["src", "cell"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum(words).over(inside), F.lit(0).cast("long"))).drop("mark", "cell", "base")


def _slots(sources: DataFrame, block: int, shard_blocks: int, seed: int) -> DataFrame:
    """``src, block, shard, slot, epoch, cut``: what every slot takes; a null cut is the whole block."""

    def draw(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                due = min(int(round(r.target)), MOST * int(r.source_size))
                n, last = slots_due(r.src, int(r.source_size), due, block, seed) if due else (0, 0)
                shards = max(1, -(-int(r.total) // (block * shard_blocks)))
                rng = np.random.default_rng([seed, pass_key(r.src, -1, seed)])
                count = rng.multinomial(n, np.full(shards, 1 / shards))
                hi = np.cumsum(count)
                at = np.flatnonzero(count)
                for i in range(0, len(at), 65_536):
                    a = at[i:i + 65_536]
                    yield pd.DataFrame({
                        "src": r.src, "shard": a, "lo": hi[a] - count[a], "hi": hi[a], "n": n, "last": last,
                        "blocks": -(-int(r.source_size) // block)})

    def expand(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                slot = np.arange(r.lo, r.hi)
                epoch = slot // r.blocks
                for e in np.unique(epoch).tolist():
                    s = slot[epoch == e]
                    yield pd.DataFrame({
                        "src": r.src, "block": permute(s % r.blocks, int(r.blocks), pass_key(r.src, e, seed)),
                        "shard": r.shard, "slot": s, "epoch": e,
                        "cut": np.where(s == r.n - 1, r.last, block)})

    drawn = sources.select("src", "source_size", "target", "total").mapInPandas(
        draw, "src string, shard long, lo long, hi long, n long, last long, blocks long")
    # A row becomes up to thousands: a fixed number of partitions spreads them.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(parts, "src", "shard").mapInPandas(
        expand, "src string, block long, shard long, slot long, epoch long, cut long")


def mix(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED):
    """``light, sources, taken`` for ``docs(doc_id, source, text)``.

    ``light``: one row per different row of docs (k1, k2, doc_id, source, src, size in words, copies);
    ``sources``: src, source, source_size, target; ``taken``: a row for every run of words of a document
    that a slot takes: k1, k2, size, shard, slot, epoch and the words ``lo`` to ``hi`` (end exclusive),
    counted over the equal rows one after the other. Null and empty texts have no words and none is taken;
    a null source is a source of its own; an empty table gives empty tables.
    """
    light, _ = stored(
        _light(docs).groupBy("k1", "k2", "doc_id", "source", "src", "size").agg(F.count("*").alias("copies")), "mix")
    sizes = light.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources, _ = stored(targets(sizes), "mix-sources")
    end = F.col("start") + F.col("size") * F.col("copies")
    first, beyond = F.col("block") * block, (F.col("block") + 1) * block
    pieces = (
        _placed(light.where("size > 0"), seed).withColumn("end", end)
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(`end` - 1) div {block}"))))
        .select("src", "block", "k1", "k2", "size", "start", F.greatest("start", first).alias("from"),
                F.least("end", beyond).alias("to")))
    taken = (
        # The planner guesses the slots from the few sources they come from and would broadcast them.
        pieces.join(_slots(sources, block, shard_blocks, seed).hint("merge"), ["src", "block"])
        .withColumn("to", F.least("to", first + F.col("cut"))).where("`to` > `from`")
        .select("k1", "k2", "size", "shard", "slot", "epoch", (F.col("from") - F.col("start")).alias("lo"),
                (F.col("to") - F.col("start")).alias("hi")))
    return light, sources, taken


def _by_copy(taken: DataFrame) -> DataFrame:
    """Cut runs at the borders of equal rows; ``copy`` numbers these from 0."""
    return taken.withColumn("copy", F.explode(F.sequence(F.expr("lo div size"), F.expr("(hi - 1) div size")))).select(
        "k1", "k2", "copy", "shard", "slot", "epoch", F.greatest(F.col("lo") - F.col("copy") * F.col("size"), F.lit(0)).alias("lo"),
        F.least(F.col("hi") - F.col("copy") * F.col("size"), F.col("size")).alias("hi"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of docs, and ``source``."""
    light, sources, taken = mix(docs)
    words = _by_copy(taken).groupBy("k1", "k2", "copy").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    rows = light.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return (
        rows.join(words, ["k1", "k2", "copy"], "left").join(sources.select("src", "source_size", "target"), "src")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source"))


def spoken(text: str, runs: list[tuple[int, int]], size: int) -> str:
    """The words of a text in the given runs; the whole text if they are all of them."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and out[-1][1] == lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    if out == [[0, size]]:
        return text
    spans = [m.span() for m in WORDS.finditer(text)]
    return "\n".join(text[spans[lo][0]:spans[hi - 1][1]] for lo, hi in out)


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs``: for every pass over a source, each document of
    which words are taken, with these words as its text (all of them: the text as it is; otherwise the runs
    of words taken, one per line) and ``n_chars`` of that text. Documents of which nothing is taken go.
    """
    _, _, taken = mix(docs, block, shard_blocks, seed)
    runs = taken.groupBy("k1", "k2").agg(F.collect_list(F.struct("epoch", "lo", "hi")).alias("runs"), F.first("size").alias("size"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys())
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")) - 1
    joined = tagged.join(runs, ["k1", "k2"]).withColumn("copy", nth)
    lo, hi = F.col("copy") * F.col("size"), (F.col("copy") + 1) * F.col("size")
    own = F.filter("runs", lambda r: (r["hi"] > lo) & (r["lo"] < hi))
    own = F.transform(own, lambda r: F.struct(
        r["epoch"].alias("epoch"), (F.greatest(r["lo"], lo) - lo).alias("lo"), (F.least(r["hi"], hi) - lo).alias("hi")))
    ready = joined.select("row", F.col("row.text").cast("string").alias("text"), "size", own.alias("runs")).where(F.size("runs") > 0)

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (t, n, rs) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                epochs: dict[int, list[tuple[int, int]]] = {}
                for r in rs:
                    epochs.setdefault(r["epoch"], []).append((r["lo"], r["hi"]))
                for e in sorted(epochs):
                    at.append(i), out.append(spoken(t.as_py(), epochs[e], n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], ["row", "text"])

    schema = T.StructType([ready.schema["row"], T.StructField("text", T.StringType())])
    made = ready.mapInArrow(run, schema)
    return made.select(*[
        F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`") for c in docs.columns])
