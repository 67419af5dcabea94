"""Vector best-fit packing of documents into fixed-length sequences (operator 11).

A document's ids are cut into pieces only where it is longer than a sequence. A sequence has three capacities:
tokens, documents and attention cost (the squares of its pieces' lengths). Pieces are placed by falling length;
of the sequences that have room in every capacity a piece takes the one whose weighted residual is then
smallest (``norm``) or whose residual has the largest weighted dot product with the piece (``dot``).

Pieces as long as a sequence are sequences of their own. All others are dealt out at random into cells of about
``CELL`` pieces, whatever document they come from, and each cell is packed by one task: a cell wastes less than
one sequence in ten thousand, and neither a long document nor a group of copies meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm import tokens
from caseload.llm.common import LOWERED, column, stored, texts, word_runs

TOKENS = 2048
DOCUMENTS = 2048
ATTENTION = TOKENS * TOKENS
WEIGHTS = (1.0, 1e-4, 1e-4)
VOCABULARY = "word_bpe_49k.json"
END = 0  # the id after every document
CELL = 32_768
TOGETHER = 1 << 14  # bytes of texts whose words are looked up at once
HELD = 20_000  # pieces that a task holds before it hands them on
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _lowered(text: bytes) -> bytes:
    """Special strings count as they are written; all else is lower-cased by the vocabulary."""
    return text if b"<|" in text else text.translate(LOWERED)


def _cut(text: bytes, known: tokens.Segments, size: int):
    """The ids of a text and its end, ``size`` at a time."""
    held = b""
    for words in word_runs(_lowered(text)):
        held += b"".join(known.of(words))
        full = len(held) // (4 * size)
        for i in range(full):
            yield held[4 * size * i:4 * size * (i + 1)]
        held = held[4 * size * full:]
    yield held + END.to_bytes(4, "little")


def _cut_together(found: list[bytes], known: tokens.Segments, size: int):
    """``_cut`` of each of several short texts, whose words are looked up at once."""
    words, ends = [], []
    for text in found:
        words += _lowered(text).split()
        ends.append(len(words))
    ids, at = known.of(words), 0
    for end in ends:
        data = b"".join(ids[at:end]) + END.to_bytes(4, "little")
        at = end
        yield [data[i:i + 4 * size] for i in range(0, len(data), 4 * size)]


def _cut_all(found: Iterable[bytes], known: tokens.Segments, size: int):
    """``_cut`` of every text, in order."""
    short, held = [], 0
    for text in found:
        if held + len(text) > TOGETHER:
            yield from _cut_together(short, known, size)
            short, held = [], 0
        if len(text) > TOGETHER:
            yield _cut(text, known, size)
        else:
            short.append(text)
            held += len(text)
    yield from _cut_together(short, known, size)


def pieces(docs: DataFrame, size: int = TOKENS, path: str | None = None, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` of every row of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit numbers, null unless asked for. A null or empty text is the end
    id alone. A text is read about a megabyte at a time, but a word without a blank is read whole.
    """
    path = path or tokens.vocabulary_path(VOCABULARY)

    def run(batches):
        known, rows = tokens.words(path), []

        def out():
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            rows.clear()
            return made

        for batch in batches:
            found = _cut_all((text or b"" for text in texts(batch)), known, size)
            for doc, parts in zip(column(batch, "doc_id").to_pylist(), found):
                for i, part in enumerate(parts):
                    rows.append((doc, i, i * size, len(part) // 4, zlib.crc32(part), part if ids else None))
                    if len(rows) >= HELD:
                        yield out()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, capacity=(TOKENS, DOCUMENTS, ATTENTION), weights=WEIGHTS, rule: str = "norm"
             ) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length. Equal lengths go in the order given; ties take the oldest bin."""
    capacity, weights = np.asarray(capacity, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    n = len(lengths)
    room = np.empty((n, 3))  # what is left of every open bin's capacities
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    opened = 0

    def scores(left: np.ndarray, need: np.ndarray) -> np.ndarray:
        after = (left - need) / capacity
        if rule == "dot":
            value = -((left / capacity) @ (weights * need / capacity))
        else:
            value = (after * after) @ weights
        return np.where((after >= 0).all(axis=-1), value, np.inf)

    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < n:
        length = lengths[order[at]]
        end = at + int(np.searchsorted(-lengths[order[at:]], -length, side="right"))
        need = np.array([length, 1.0, float(length) * length])
        score = np.full(opened + end - at, np.inf)
        score[:opened] = scores(room[:opened], need)
        for i in order[at:end]:
            best = int(np.argmin(score)) if len(score) else 0
            if not len(score) or score[best] == np.inf:
                best = opened
                room[best] = capacity
                opened += 1
            bins[i], offsets[i] = best, capacity[0] - room[best, 0]
            room[best] -= need
            score[best] = scores(room[best], need)
        at = end
    return bins, offsets


def pack(docs: DataFrame, size: int = TOKENS, documents: int = DOCUMENTS, attention: int | None = None,
         weights=WEIGHTS, rule: str = "norm", path: str | None = None, ids: bool = False, cell: int = CELL) -> DataFrame:
    """The columns of ``pieces`` with ``sequence_id`` and ``offset`` for every row of ``docs(doc_id, text)``.

    No sequence has more than ``size`` tokens, ``documents`` pieces or ``attention`` cost (at least ``size``
    squared, so that every piece fits an empty sequence). Repeated rows and rows with a null doc_id are packed
    each; other columns of any name are not read. An empty table gives an empty table.
    """
    attention = size * size if attention is None else attention
    if documents < 1 or attention < size * size:
        raise ValueError("an empty sequence must have room for every piece")
    rows, _ = stored(pieces(docs, size, path, ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = rows.where(F.col("length") < size)
    cells = -(-part.count() // cell) or 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        bins, offsets = best_fit(frame["length"].to_numpy(), (size, documents, attention), weights, rule)
        return pd.DataFrame({
            "row": frame["row"], "sequence_id": 2 * (frame["cell"].to_numpy() * (1 << 24) + bins), "offset": offsets})

    placed = (
        part.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(cells)).alias("cell"))
        .groupBy("cell").applyInPandas(run, "row long, sequence_id long, offset long"))
    alone = rows.where(F.col("length") == size).withColumn("sequence_id", 2 * F.col("row") + 1).withColumn(
        "offset", F.lit(0).cast("long"))
    return part.join(placed, "row").unionByName(alone).drop("row", *([] if ids else ["ids"]))


def sequences(docs: DataFrame, **options) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: every packed sequence with its ids as little-endian 32-bit numbers."""
    rows = pack(docs, ids=True, **options).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return rows.select(
        "sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(docs)
