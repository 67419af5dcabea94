"""Benchmark decontamination with training suffix arrays (operator 4).

The documents are the training side. Each task turns its rows into shards of about ``SHARD`` words,
builds the suffix array of a shard and binary-searches every suffix of every benchmark item in it. Only
suffixes that can start a match enter the array: those whose words all occur in the benchmark for as long
as the shortest window; a word that no item has ends every match, so nothing is lost. The array is sorted
by the first ``window`` words, which fixes the range of every match of a window; matches are then
lengthened word by word to their longest extent.

The benchmark reaches the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the rows per block
inside the same stage, so its size is bounded wherever it is held. No row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import LOWER_AZ, SPAN, UPPER_AZ, column, texts, word_runs

WINDOW = 13
SHARD = 1_000_000
BLOCK_BYTES = 32 << 20
_KEPT = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(0x80, 0x100))
# Bytes of a word stay, A-Z become a-z, everything else becomes a blank.
TO_WORDS = bytes(
    c if c in _KEPT else ord(LOWER_AZ[UPPER_AZ.index(chr(c))]) if chr(c) in UPPER_AZ else 0x20 for c in range(256))


@dataclass
class Items:
    """A block of benchmark items: word numbers from 1, the suffix windows and the items that have each."""

    window: int
    ids: dict[bytes, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    seqs: list[np.ndarray] = field(default_factory=list)

    def add(self, name: str, text: bytes | None) -> None:
        words = (text or b"").translate(TO_WORDS).split()
        if words:
            self.names.append(name)
            self.seqs.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], dtype=np.uint32))

    def close(self) -> Items:
        """Lay out the suffixes: one row per suffix that is a window, padded with 0."""
        rows, owner, size, rest = [], [], [], []
        for k, seq in enumerate(self.seqs):
            w = min(self.window, len(seq))
            for i in range(len(seq) - w + 1):
                rows.append(np.pad(seq[i:i + w], (0, self.window - w)))
                owner.append(k), size.append(w), rest.append(i)
        self.rows = np.array(rows, dtype=np.uint32).reshape(-1, self.window)
        self.owner, self.size, self.start = (np.array(x, dtype=np.int64) for x in (owner, size, rest))
        self.least = int(self.size.min()) if len(rows) else 0
        # Equal windows are searched once; their items are looked up afterwards.
        keyed = np.concatenate([self.rows, self.size[:, None].astype(np.uint32)], axis=1)
        _, first, self.group = np.unique(keyed, axis=0, return_index=True, return_inverse=True)
        self.group = self.group.ravel()
        self.first = first
        order = np.argsort(self.group, kind="stable")
        self.members = np.split(order, np.flatnonzero(np.diff(self.group[order])) + 1) if len(rows) else []
        return self


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as fixed-length byte strings that sort as the rows do."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """The suffix array of some documents' words, given as numbers (0: not in the benchmark)."""

    def __init__(self, seqs: list[np.ndarray], items: Items) -> None:
        self.items = items
        self.words = np.concatenate([*(np.append(s, np.uint32(0)) for s in seqs), np.zeros(items.window, np.uint32)])
        self.ends = np.cumsum([len(s) + 1 for s in seqs])
        # Number of benchmark words from each position on.
        stop = np.flatnonzero(self.words == 0)
        at = np.flatnonzero(self.words)
        run = stop[np.searchsorted(stop, at)] - at
        at, run = at[run >= items.least], run[run >= items.least]
        depth = np.arange(items.window)
        rows = np.where(depth < run[:, None], self.words[at[:, None] + depth], 0)
        keys = as_keys(rows) if len(at) else np.empty(0, f"S{4 * items.window}")
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and window groups of every occurrence, by two binary searches per window."""
        it = self.items
        low = it.rows[it.first]
        size = it.size[it.first]
        high = np.where(np.arange(it.window) < size[:, None], low, np.uint32(0xFFFFFFFF))
        lo = np.searchsorted(self.keys, as_keys(low), "left")
        hi = np.searchsorted(self.keys, as_keys(high), "right")
        n = np.maximum(hi - lo, 0)
        group = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.suffixes[np.repeat(lo, n) + inside], group

    def longest(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Length of the longest verbatim match that starts at each occurrence, over the items with its window."""
        best = self.items.size[self.items.first][group].copy()
        for g in np.unique(group):
            here = np.flatnonzero(group == g)
            for m in self.items.members[g]:
                seq, start = self.items.seqs[self.items.owner[m]], self.items.start[m]
                alive, k = here, int(self.items.size[m])
                while len(alive) and start + k < len(seq):
                    alive = alive[self.words[at[alive] + k] == seq[start + k]]
                    k += 1
                    best[alive] = np.maximum(best[alive], k)
        return best


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def scan_shard(seqs: list[np.ndarray], items: Items) -> list[tuple[list[tuple[int, int]], set[str], int]]:
    """For each document: merged hit spans in words, names of the items found, longest match."""
    out: list[tuple[list[tuple[int, int]], set[str], int]] = [([], set(), 0) for _ in seqs]
    if not len(items.rows):
        return out
    shard = Shard(seqs, items)
    at, group = shard.matches()
    if not len(at):
        return out
    length, size = shard.longest(at, group), items.size[items.first][group]
    doc = np.searchsorted(shard.ends, at, "right")
    order = np.argsort(doc, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        d = int(doc[part[0]])
        base = int(shard.ends[d] - len(seqs[d]) - 1)
        spans = merged(list(zip((at[part] - base).tolist(), (at[part] - base + size[part]).tolist())))
        names = {items.names[items.owner[m]] for g in np.unique(group[part]).tolist() for m in items.members[g]}
        out[d] = (spans, names, int(length[part].max()))
    return out


def _numbers(text: bytes | None, ids: dict[bytes, int]) -> np.ndarray:
    parts = [
        np.fromiter((ids.get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        for words in word_runs((text or b"").translate(TO_WORDS), SPAN)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _pass(shared):
    """One pass of a block of items over batches of rows, adding to what earlier blocks have found."""

    def run(batches):
        items = shared.value.close()
        for batch in batches:
            old = [batch.column(batch.schema.get_field_index(n)) for n in ("hits", "items", "longest", "n_words")]
            found, seqs, held = [], [], 0
            counts = []
            for t in texts(batch):
                seqs.append(_numbers(t, items.ids))
                counts.append(len(seqs[-1]))
                held += counts[-1]
                if held >= SHARD:
                    found += scan_shard(seqs, items)
                    seqs, held = [], 0
            found += scan_shard(seqs, items) if seqs else []
            hits, names, longest = [], [], []
            for i, (spans, got, most) in enumerate(found):
                was = [(s["lo"], s["hi"]) for s in old[0][i].as_py()] if len(old[0][i]) else []
                spans = merged(spans + was) if was else spans
                hits.append([{"lo": a, "hi": b} for a, b in spans])
                names.append(sorted(got | set(old[1][i].as_py())))
                longest.append(max(most, old[2][i].as_py()))
            new = {
                "hits": pa.array(hits, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                "items": pa.array(names, pa.list_(pa.string())), "longest": pa.array(longest, pa.int64()),
                "n_words": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The items in order of their names, as blocks of bounded size."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string"))
    items, held = Items(window), 0
    for r in rows.sort("name", "text").toLocalIterator():
        if held >= block_bytes:
            yield items
            items, held = Items(window), 0
        items.add(r["name"], r["text"].encode() if r["text"] is not None else None)
        held += 64 + len(r["text"] or "") * 4
    yield items


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, found`` for every row of ``docs``: the row as it is and what of the benchmark it holds.

    ``found.hits``: spans of words inside occurrences of windows; ``found.items``: names of the items found,
    sorted; ``found.longest``: words of the longest verbatim match; ``found.n_words``. A window is ``window``
    consecutive words of an item, or the whole of a shorter one. Null and empty texts have no words; items
    without words have no window; items of equal name count once, a null name is the empty text. Repeated
    rows are returned each; an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names).select(
        F.struct(*names).alias("row"), F.col(names[docs.columns.index("text")]).cast("string").alias("text"),
        F.expr("cast(array() as array<struct<lo:long,hi:long>>)").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"), F.expr("0L").alias("longest"), F.expr("0L").alias("n_words"))
    schema = out.schema
    for items in _blocks(benchmark, window, block_bytes):
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(items)), schema)
    fields = [F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns)]
    return out.select(F.struct(*fields).alias("row"), F.struct("hits", "items", "longest", "n_words").alias("found"))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, found, n_hit, contaminated``; contaminated: at least a twentieth of the words are hit."""
    n_hit = F.aggregate("found.hits", F.expr("0L"), lambda n, s: n + s["hi"] - s["lo"])
    return search(docs, benchmark, window).withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("found.n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    return judged(docs, benchmark).where(~F.col("contaminated")).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(docs.select("doc_id", "text"), benchmark).select(
        "row.doc_id", "found.n_words", "n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, i, n, item FROM dw JOIN bw USING (n, win)),
words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, n, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
