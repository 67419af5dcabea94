"""SimHash near-duplicates with pivot distance tables (operator 2).

A fingerprint has 64 bits: a bit is set if more than half of the hashed word shingles have it. Two texts
are linked if their fingerprints differ in at most ``bits`` places.

Candidate search. Fingerprints that differ in at most ``d`` of 64 bits agree on at least two of ``d + 2``
bands, so every link lies inside a bucket of equal band pairs: the buckets lose no link. Inside a bucket
the distances of each fingerprint to many reference fingerprints (pivots) are tabulated; by the triangle
inequality a pair whose table rows differ by more than ``d`` in any coordinate can't be a link and is
discarded; the survivors are verified bit by bit. A bucket of any size is dealt out as blocks of about
``BLOCK`` rows, and every pair of blocks is its own cell, so no task holds a whole hot bucket and no pair
is skipped. A cell returns a spanning forest of its links, at most one row for each of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.llm.common import LOWERED, column, stored, texts, word_runs
from caseload.llm.links import components

SEED = 42
BLOCK = 512
PIVOTS = 24
BYTE_AT = np.arange(8, dtype=np.int64) * 256
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``size`` words; a shorter text is one shingle, no words give none."""
    kept: list[bytes] = []
    whole = True
    for words in word_runs(text.translate(LOWERED)):
        words = kept + words
        if len(words) >= size:
            whole = False
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            yield np.array(
                [xxhash.xxh64_intdigest(joined[i:j], SEED)
                 for i, j in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())], dtype=np.uint64)
            words = words[len(words) - size + 1:]
        kept = words
    if whole and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a null text and a text without words."""
    counts, n = np.zeros((8, 8), dtype=np.int64), 0
    for h in _hashes(text or b"", size):
        n += len(h)
        at = h.astype("<u8").view(np.uint8).reshape(-1, 8) + BYTE_AT
        counts += np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS_OF
    return int(np.packbits(2 * counts > n, axis=1, bitorder="little").ravel().view("<i8")[0]) if n else 0


def _mark() -> Column:
    """Tells apart rows of the same id by their text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("text"))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, mark, fp`` of every row; ``fp`` is the signed fingerprint of the whole text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "mark"),
                 pa.array([fingerprint(t, size) for t in texts(batch)], pa.int64())], ["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark")).mapInArrow(
        run, "doc_id long, mark long, fp long")


def _buckets(fp: Column, bits: int) -> Column:
    """The band pairs of a fingerprint as numbers, the pair's place in the upper bits."""
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    bands = [
        F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[
        F.xxhash64(F.lit(i), a, b) for i, (a, b) in enumerate(combinations(bands, 2))])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each of ``n`` rows reaches over the links ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def cell_links(cell: np.ndarray, fp: np.ndarray, bits: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each cell; rows of a cell stand together."""
    near = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    root, left, right, held = np.arange(len(fp)), [], [], 0
    i = np.arange(len(fp))
    step = 0

    def fold_in():
        nonlocal root, left, right, held
        a, b = np.concatenate([np.arange(len(fp)), *left]), np.concatenate([root, *right])
        root, left, right, held = _forest(len(fp), a, b), [], [], 0

    while True:
        step += 1
        i = i[i + step < len(fp)]
        i = i[cell[i] == cell[i + step]]
        if not len(i):
            break
        # Rows that a shift has already joined need no further proof.
        pair = i[root[i] != root[i + step]]
        for lo in range(0, near.shape[1], 4):
            gap = np.abs(near[pair, lo:lo + 4] - near[pair + step, lo:lo + 4]).max(axis=1, initial=0)
            pair = pair[gap <= bits]
        pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + step]) <= bits]
        if len(pair):
            left.append(pair), right.append(pair + step)
            held += len(pair)
            if held > 4 * len(fp):
                fold_in()
    if held:
        fold_in()
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def near_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of ``fps(fp)`` that join what is within ``bits``."""
    refs = pivots()
    rows = fps.select("fp", F.explode(_buckets(F.col("fp"), bits)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    cells = (
        rows.join(sizes, "bucket")
        .select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp"))

    def run(batches):
        kept_cell, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(cell, fp):
            a, b = cell_links(cell, fp, bits, refs)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cell = np.concatenate([kept_cell, column(batch, "cell").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([kept_fp, column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            kept_cell, kept_fp = cell[cut:], fp[cut:]
            if cut:
                yield out(cell[:cut], fp[:cut])
        if len(kept_cell):
            yield out(kept_cell, kept_fp)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id, mark, fp, root, component_id`` for every row of ``docs(doc_id, text)``.

    ``root`` is one fingerprint of the component, ``component_id`` the smallest doc_id that can be reached
    over links, the row's own included. A null text and a text without words have fingerprint 0 and are
    linked like any other. Repeated rows are returned each. A null doc_id takes part in links and names no
    component: where a component has no other, component_id is null. An empty table gives an empty table.
    """
    prints, _ = stored(fingerprints(docs, size), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row left of each component, all columns kept.

    The row of the smallest doc_id stays (null last), of several with that id the one with the smallest
    text hash, and one of equal rows.
    """
    zero = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    keep = (
        near_duplicates(docs, size, bits).groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), zero.alias("id"), "mark")).alias("k")).select("k.id", "k.mark"))
    tagged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), _mark().alias("mark"))
    first = Window.partitionBy("id", "mark").orderBy("mark")
    return (
        tagged.join(keep, ["id", "mark"], "left_semi").withColumn("nth", F.row_number().over(first))
        .where("nth = 1").select("row.*"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
