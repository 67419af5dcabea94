"""Alignment of two tokenizers by an associative monoid of fragments (operator 12).

Both vocabularies split the same bytes; the byte offsets where a token of each ends cut a document into groups.
A document's bytes are cut into ranges of ``CHUNK``. A range gives a fragment: the tokens that end in it, as an
open prefix (up to the first common end, as its group began further left), closed groups, and an open suffix
(after the last common end). Two neighbouring fragments compose to one: the left suffix and the right prefix make
a closed group, or an open piece where a side has no common end. Composition is associative, so the fragments of
a very long document, made by many tasks, are reduced as a tree of small groups; the text of closed groups
is never moved up the tree, only the seams are.

Tokens need their surroundings: a range is tokenized from the last border at or before it to the first one
after it. A border is a single blank between two characters that aren't white space; no token and no rule of
the two vocabularies runs over it (``Pair`` checks the pieces). A stretch without borders that is longer than a
range is never cut.

The corpus-wide counts of id pairs are joined back in two parts: pairs with at least one in ``SHARE`` links are
fewer than ``SHARE`` and are broadcast, all others are joined by a shuffle in which no key is hot.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm import tokens
from caseload.llm.common import column, stored, texts

CHUNK = 1 << 15
FAN = 8
SHARE = 400_000
KNOWN_SCRIPTS = "\u0530"  # Latin, Greek and Cyrillic letters lie below
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
LINKS = "array<struct<pair:int,n:int>>"
TOKEN = np.dtype([("id", "<i8"), ("end", "<i8")])  # end: byte offset in the document with its leading blank
NONE = np.empty(0, TOKEN)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones for themselves, the others
    in order from code point 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Two vocabularies: the bytes of their ids, and the tokens of a window."""

    def __init__(self, a_path: str, b_path: str):
        self.a = tokens.tokenizer(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        # Merges have rising ids, so the ids are ranks, and the same vocabulary runs three times as fast.
        ranks = {self.a_bytes[i]: i for piece, i in vocab.items() if piece not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece runs over a border")
        if len(self.a_bytes) * len(pieces) >= 1 << 31:
            raise ValueError("a pair of ids must fit 31 bits")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        n = len(self.a_bytes)
        self.b_from = 2 * n
        self.shown = [f"{i}{s}".encode() for i in range(n) for s in ",|"] + [f"{i}{s}".encode() for i in range(len(pieces)) for s in ",;"]

    def tokens(self, window: bytes, at: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Tokens of a window that begins with a blank, ``at`` bytes into its document.

        None if the tokens of either side don't give its bytes again.
        """
        text = window.decode("utf-8", "replace")
        # Character classes of newer scripts may differ between the libraries.
        if text.isascii() or max(text) < KNOWN_SCRIPTS:
            left = self.fast.encode_ordinary(text)
        else:
            left = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        sides = []
        for ids, table, size in ((left, self.a_bytes, self.a_size), (self.b.encode(text[1:]), self.b_bytes, self.b_size)):
            if b"".join(map(table.__getitem__, ids)) != window:
                return None
            side = np.empty(len(ids), TOKEN)
            side["id"] = ids
            side["end"] = np.cumsum(size[side["id"]]) + at
            sides.append(side)
        return sides[0], sides[1]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


@dataclass
class Fragment:
    """The tokens that end in a byte range. Without a common end in the range all of them are the suffix."""

    shut: bool = False  # a common end lies in the range
    prefix: tuple[np.ndarray, np.ndarray] = (NONE, NONE)
    suffix: tuple[np.ndarray, np.ndarray] = (NONE, NONE)
    groups: int = 0
    links: int = 0
    seams: list = field(default_factory=list)  # closed by composition: end, text, pairs, times


def _closed(p: Pair, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Closed groups: their text, the pair of every link, and how many there are; both sides have the same last end."""
    start = min(a["end"][0], b["end"][0])
    a_end, b_end = a["end"] - start, b["end"] - start
    is_a, is_b = (np.zeros(int(a_end[-1]) + 1, np.int32) for _ in "ab")  # one for every byte where a token ends
    is_a[a_end], is_b[b_end] = 1, 1
    common = is_a & is_b
    a_until, b_until, groups = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(common)
    ends = np.flatnonzero(common)
    # In the text, the tokens of a group follow those of all groups before it, A before B.
    b_before = np.concatenate(([0], b_until[ends]))[(groups - common)[a_end]]
    a_before = a_until[ends][(groups - common)[b_end]]
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + b_before] = 2 * a["id"] + common[a_end]
    shown[np.arange(len(b)) + a_before] = p.b_from + 2 * b["id"] + common[b_end]
    cuts = np.flatnonzero(is_a | is_b)  # a link lies between two ends that follow each other
    pairs = a["id"][(a_until - is_a)[cuts]] * len(p.b_bytes) + b["id"][(b_until - is_b)[cuts]]
    return b"".join(map(p.shown.__getitem__, shown.tolist()))[:-1], pairs.astype(np.int32), len(ends)


def _common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.empty(0, np.int64)
    start = min(a["end"][0], b["end"][0])
    at = np.zeros(int(max(a["end"][-1], b["end"][-1]) - start) + 1, bool)
    at[b["end"] - start] = True
    return a["end"][at[a["end"] - start]]


def fragment(p: Pair, a: np.ndarray, b: np.ndarray, first: bool) -> tuple[Fragment, int, bytes, np.ndarray]:
    """The fragment of the tokens that end in a range, where its closed groups begin, their text and their links' pairs.

    The range of a document's first byte is shut on the left.
    """
    ends = _common_ends(a, b)
    if not len(ends):
        return Fragment(shut=first, suffix=(a, b)), 0, b"", np.empty(0, np.int32)
    low = [0, 0] if first else [int(np.searchsorted(s["end"], ends[0], "right")) for s in (a, b)]
    high = [int(np.searchsorted(s["end"], ends[-1], "right")) for s in (a, b)]
    inner = [s[i:j] for s, i, j in zip((a, b), low, high)]
    text, pairs, groups = _closed(p, *inner) if len(inner[0]) else (b"", np.empty(0, np.int32), 0)
    made = Fragment(True, (a[:low[0]], b[:low[1]]), (a[high[0]:], b[high[1]:]), groups, len(pairs))
    return made, 0 if first else int(ends[0]), text, pairs


def compose(p: Pair, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    both = [tuple(np.concatenate(s) for s in zip(x, y)) for x, y in (
        (left.suffix, right.suffix), (left.suffix, right.prefix))]
    groups, links, seams = left.groups + right.groups, left.links + right.links, left.seams + right.seams
    if not right.shut:
        return Fragment(left.shut, left.prefix, both[0], groups, links, seams)
    if not left.shut:
        return Fragment(True, both[1], right.suffix, groups, links, seams)
    a, b = both[1]
    if len(a) or len(b):
        text, pairs, _ = _closed(p, a, b)
        seams = [*left.seams, (int(a["end"][-1]), text, *_counted(pairs)), *right.seams]
        groups, links = groups + 1, links + len(pairs)
    return Fragment(True, left.prefix, right.suffix, groups, links, seams)


def _counted(pairs: np.ndarray) -> tuple[list[int], list[int]]:
    kinds, times = np.unique(pairs, return_counts=True)
    return kinds.tolist(), times.tolist()


def _is_border(data: bytes, at: int) -> bool:
    before = data[max(0, at - 4):at].decode("utf-8", "ignore")[-1:]
    after = data[at + 1:at + 5].decode("utf-8", "ignore")[:1]
    return bool(before and after) and not before.isspace() and not after.isspace()


def _border(data: bytes, at: int, step: int) -> int:
    """The nearest border at or after ``at`` (step 1) or at or before it (-1), or the document's end there."""
    while True:
        at = data.find(b" ", at) if step > 0 else data.rfind(b" ", 0, at + 1)
        if at <= 0:
            return len(data) if step > 0 else 0
        if _is_border(data, at):
            return at
        at += step


def windows(data: bytes, chunk: int):
    """``lo, hi, at, end`` of every range of a document's bytes and of the window that it's tokenized in."""
    lo, at = 0, 0
    while lo < len(data):
        hi = min(lo + chunk, len(data))
        end = _border(data, hi, 1) if hi < len(data) else hi
        back = _border(data, hi, -1)
        if end - back > chunk:
            hi = back = end  # a stretch without borders isn't cut
        yield lo, hi, at, end
        lo, at = hi, back


CHUNKS = "row long, doc_id long, no int, last boolean, lo long, hi long, at long, window binary"
PARTS = (
    "row long, doc_id long, no int, last boolean, same boolean, shut boolean, n_a long, n_b long, n_groups long, n_links long, "
    "begin long, body binary, digest string, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary, links " + LINKS)
SEAMS = "array<struct<end:long,text:binary,pairs:array<int>,times:array<int>>>"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
ENDS = ["prefix_a", "prefix_b", "suffix_a", "suffix_b"]
TREE = f"row long, doc_id long, no int, same boolean, shut boolean, {', '.join(c + ' long' for c in COUNTS)}, " + \
    ", ".join(e + " binary" for e in ENDS) + f", seams {SEAMS}"


def _ranges(docs: DataFrame, chunk: int) -> DataFrame:
    """The ranges of all documents; those of long ones are spread over all tasks."""
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    short = light.where(size <= chunk).select(
        F.col("row") * 2, "doc_id", F.lit(0), F.lit(True), F.lit(0).cast("long"), size.cast("long"), F.lit(0).cast("long"),
        F.when(F.length("text") > 0, F.concat(F.lit(" "), F.col("text")).cast("binary")))

    def run(batches):
        for batch in batches:
            for row, doc, text in zip(column(batch, "row").to_pylist(), column(batch, "doc_id").to_pylist(), texts(batch)):
                data = b" " + text
                for no, (lo, hi, at, end) in enumerate(windows(data, chunk)):
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "doc_id": doc, "no": no, "last": hi == len(data), "lo": lo, "hi": hi, "at": at,
                          "window": data[at:end]}],
                        pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("last", pa.bool_()),
                                   ("lo", pa.int64()), ("hi", pa.int64()), ("at", pa.int64()), ("window", pa.binary())]))

    long = light.where(size > chunk).withColumn("row", F.col("row") * 2 + 1).mapInArrow(run, CHUNKS).repartition("row", "no")
    return short.toDF(*long.columns).union(long)


def _fragments(ranges: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per range; a document of one range has its digest at once and keeps no text."""
    names = ["row", "doc_id", "no", "last", "same", "shut", *COUNTS, "begin", "body", "digest", *ENDS, "links"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5, pa.binary(), pa.string(),
             *[pa.binary()] * 4, pa.list_(pa.struct([("pair", pa.int32()), ("n", pa.int32())]))]

    def run(batches):
        p = pair(a_path, b_path)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            cols = {n: column(batch, n).to_pylist() for n in ("row", "doc_id", "no", "last", "lo", "hi", "at")}
            rows, pairs, times, lengths = [], [], [], []
            for row, doc, no, last, lo, hi, at, window in zip(*cols.values(), texts(batch, "window")):
                sides = p.tokens(window, at) if window else None
                if not sides:  # the document has no tokens
                    rows.append((row, doc, no, last, False, True, 0, 0, 0, 0, 0, b"", "", *[b""] * 4))
                    lengths.append(0)
                    continue
                whole = no == 0 and last
                if not whole:
                    sides = [s[slice(*np.searchsorted(s["end"], [lo, hi], "right"))] for s in sides]
                made, begin, text, found = fragment(p, *sides, no == 0)
                rows.append((
                    row, doc, no, last, True, made.shut, *map(len, sides), made.groups, made.links, begin,
                    b"" if whole else text, hashlib.sha256(text).hexdigest() if whole else None,
                    *(s.tobytes() for s in (*made.prefix, *made.suffix))))
                kind, count = np.unique(found, return_counts=True)
                pairs.append(kind), times.append(count), lengths.append(len(kind))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int32)) for x in (pairs, times)], ["pair", "n"])
            links = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), links.cast(kinds[-1])], names)

    return ranges.mapInArrow(run, PARTS)


def _reduced(parts: DataFrame, a_path: str, b_path: str, fan: int) -> DataFrame:
    """One fragment per document of several ranges, by levels of ``fan`` neighbours."""
    now = parts.select("row", "doc_id", "no", "same", "shut", *COUNTS, *ENDS).withColumn("seams", F.expr(f"cast(array() as {SEAMS})"))
    most = now.agg(F.max("no")).first()[0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = pair(a_path, b_path)
        frame = frame.sort_values("no")
        whole, one = None, frame.iloc[0]
        for r in frame.itertuples():
            sides = [np.frombuffer(getattr(r, e), TOKEN) for e in ENDS]
            seams = [tuple(s[k] for k in ("end", "text", "pairs", "times")) if isinstance(s, dict) else tuple(s) for s in r.seams]
            made = Fragment(r.shut, tuple(sides[:2]), tuple(sides[2:]), r.n_groups, r.n_links, seams)
            whole = made if whole is None else compose(p, whole, made)
        names = ("end", "text", "pairs", "times")
        return pd.DataFrame([{
            "row": one["row"], "doc_id": one["doc_id"], "no": int(one["no"]) // fan, "same": bool(frame["same"].all()),
            "shut": whole.shut, "n_a": frame["n_a"].sum(), "n_b": frame["n_b"].sum(), "n_groups": whole.groups, "n_links": whole.links,
            **{e: s.tobytes() for e, s in zip(ENDS, (*whole.prefix, *whole.suffix))},
            "seams": [dict(zip(names, (end, bytes(text), list(map(int, kinds)), list(map(int, times)))))
                      for end, text, kinds, times in whole.seams]}]).astype({"doc_id": "Int64"})

    while most:
        now, _ = stored(now.groupBy("row", F.expr(f"no div {fan}").alias("level")).applyInPandas(
            lambda key, frame: run(frame), TREE), "fragments")
        most //= fan
    return now


def _digests(pieces: DataFrame) -> DataFrame:
    """``row, digest`` of the texts ``row, at, text`` in order, joined by semicolons; one text is held at a time."""

    def run(batches):
        row, state = None, None
        for batch in batches:
            done = []
            for r, text in zip(column(batch, "row").to_pylist(), texts(batch)):
                if r != row:
                    if state:
                        done.append((row, state.hexdigest()))
                    row, state = r, hashlib.sha256(text)
                else:
                    state.update(b";" + text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["row", "digest"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([state.hexdigest()])], ["row", "digest"])

    return pieces.repartition("row").sortWithinPartitions("row", "at").select("row", "text").mapInArrow(run, "row long, digest string")


def _pair_counts(links: DataFrame, kinds: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Corpus-wide ``pair, c, best`` of the frequent pairs (fewer than ``share``) and of all others."""
    counts, _ = stored(links.groupBy("pair").agg(F.sum("n").cast("long").alias("c")), "pairs")
    right = F.col("pair") % kinds
    highest = counts.groupBy(right.alias("b")).agg(F.max("c").alias("high"))  # one row per id of the vocabulary
    marked = counts.withColumn("b", right).join(F.broadcast(highest), "b").select(
        "pair", "c", (F.col("c") == F.col("high")).cast("long").alias("best"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    often = F.col("c") * share > F.lit(total)
    return marked.where(often), marked.where(~often)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK, fan: int = FAN,
          share: int = SHARE) -> DataFrame:
    """The contract's columns for every row of ``docs(doc_id, text)``.

    A null or empty text, and one whose bytes either vocabulary doesn't give again, has zeros and an empty
    digest. Repeated rows and rows of a null doc_id are aligned each, and each counts in the corpus. Other
    columns of any name are not read. An empty table gives an empty table. A text of any length is cut into
    ranges by the task that reads it; its ranges are tokenized, aligned and counted by all tasks, and only the
    hash over its groups' texts runs in one task, which holds the text of one range at a time.
    """
    a_path, b_path = a_path or tokens.vocabulary_path(BYTE_LEVEL), b_path or tokens.vocabulary_path(PIECES)
    parts, _ = stored(_fragments(_ranges(docs, chunk), a_path, b_path), "ranges")
    alone = (F.col("no") == 0) & F.col("last")
    rest = _reduced(parts.where(~alone), a_path, b_path, fan)
    seams = rest.where("same").select("row", F.explode("seams").alias("s"))
    good = rest.where("same").select("row")
    inner = parts.where(~alone).where("n_groups > 0").join(good, "row", "left_semi")
    digests = _digests(
        inner.select("row", F.col("begin").alias("at"), F.col("body").alias("text"))
        # a range's groups begin where the group that ends there is closed, so that one comes first
        .union(seams.select("row", F.col("s.end") - 1, "s.text")))
    links = (
        parts.where(alone).select("row", F.explode("links").alias("l"))
        .union(inner.select("row", F.explode("links")))
        .union(seams.select("row", F.explode(F.expr(
            f"cast(transform(s.pairs, (x, i) -> named_struct('pair', x, 'n', s.times[i])) as {LINKS})"))))
        .select("row", "l.pair", "l.n"))
    often, seldom = _pair_counts(links, len(pair(a_path, b_path).b_bytes), share)
    looked_up = links.join(F.broadcast(often), "pair", "left")
    sums = [F.sum(F.col("n") * F.col("c")).alias("count_sum"), F.sum(F.col("n") * F.col("best")).alias("n_best")]
    scored = (
        looked_up.where("c is not null").groupBy("row").agg(*sums)
        .union(looked_up.where("c is null").select("row", "pair", "n").join(seldom, "pair").groupBy("row").agg(*sums))
        .groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    light = ["row", "doc_id", *COUNTS]
    docs_out = parts.where(alone).select(*light, "digest").union(
        rest.where("same").select(*light).join(digests, "row", "left")).union(
        rest.where("not same").select("row", "doc_id", *[F.lit(0).cast("long")] * 4, F.lit("")))
    zero = F.lit(0).cast("long")
    return docs_out.join(scored, "row", "left").select(
        "doc_id", *COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        F.col("digest").alias("groups_sha256"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns with the public vocabularies."""
    return align(docs)
