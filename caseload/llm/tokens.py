"""Tokens of public vocabularies, word by word with a bounded table of words seen before.

Vocabulary files are named by a path that every executor can read; nothing is trained or copied.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

KNOWN = 1 << 19  # segments held per vocabulary; of a full table the older half goes
LONGEST = 64  # bytes of a segment that is held


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


class Segments:
    """What ``encode(segments, known)`` gives for each segment, remembered within a bound."""

    def __init__(self, encode):
        self.encode, self.known = encode, {}

    def of(self, segments: list) -> list:
        out = list(map(self.known.get, segments))
        holes = [i for i, seen in enumerate(out) if seen is None]
        if not holes:
            return out
        new = list({segments[i] for i in holes})
        made = dict(zip(new, self.encode(new, self.known)))
        for i in holes:
            out[i] = made[segments[i]]
        self.known.update((s, x) for s, x in made.items() if len(s) <= LONGEST)
        if len(self.known) > KNOWN:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        return out


def parts(ids: np.ndarray, begins: np.ndarray, count: int) -> list[bytes] | None:
    """Ids of segments encoded side by side as 32-bit numbers, one text of bytes per segment.

    ``begins`` tells which ids begin a segment; None if these aren't ``count``.
    """
    at = 4 * np.flatnonzero(begins)
    if len(at) != count or at[0]:
        return None
    data = ids.tobytes()
    return [data[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(data)])]


# Letters that every step of the vocabulary keeps one by one, then marks that are a token group of their own.
PLAIN = re.compile(rb"((?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([.,;:!?]*+)")


@lru_cache(maxsize=4)
def words(path: str) -> Segments:
    """Ids of blank-separated words (bytes) as little-endian unsigned 32-bit numbers, special strings included.

    Only for a vocabulary that drops white space and marks the ends of words, so that no token and no rule runs
    over a blank. Plain words are encoded side by side in one text and told apart by those marks.
    """
    made = tokenizer(path)
    ends = np.zeros(made.get_vocab_size(), bool)
    for piece, i in made.get_vocab().items():
        ends[i] = piece.endswith("</w>")
    marks: dict[bytes, bytes] = {b"": b""}

    def single(batch: list[bytes]) -> list[bytes]:
        found = made.encode_batch_fast([w.decode("utf-8", "replace") for w in batch], add_special_tokens=False)
        return [np.array(f.ids, "<i4").tobytes() for f in found]

    def side_by_side(batch: list[bytes]) -> list[bytes]:
        ids = np.array(made.encode_batch_fast([b" ".join(batch).decode()], add_special_tokens=False)[0].ids, "<i4")
        # An id begins a word if the one before it ends one.
        return parts(ids, np.concatenate(([True], ends[ids[:-1]])), len(batch)) or single(batch)

    def encode(batch: list[bytes], seen: dict[bytes, bytes]) -> list[bytes]:
        plain = {w: m.groups() for w, m in zip(batch, map(PLAIN.fullmatch, batch)) if m}
        known = {stem: seen.get(stem) for stem, _ in plain.values()}
        stems = [stem for stem, ids in known.items() if ids is None]
        if stems:
            known.update(zip(stems, side_by_side(stems)))
        tails = list({tail for _, tail in plain.values()} - marks.keys())
        if tails:
            if len(marks) > KNOWN:
                marks.clear()
                marks[b""] = b""
                tails = list({tail for _, tail in plain.values()} - marks.keys())
            marks.update(zip(tails, single(tails)))
        rest = [w for w in batch if w not in plain]
        known_rest = dict(zip(rest, single(rest))) if rest else {}
        return [known[plain[w][0]] + marks[plain[w][1]] if w in plain else known_rest[w] for w in batch]

    return Segments(encode)
