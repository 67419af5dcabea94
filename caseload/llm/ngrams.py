"""Hashed character n-grams of whole texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20  # characters whose n-grams are held at a time
FACTOR = np.uint32(0x01000193)
SPREAD = np.uint32(0x9E3779B1)


def pieces(text: str, most: int) -> Iterator[np.ndarray]:
    """Code points of a text, about ``PIECE`` at a time, each piece with the last ``most - 1`` of the one before."""
    at = 0
    while True:
        yield np.frombuffer(text[max(0, at - most + 1):at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at += PIECE
        if at >= len(text):
            return


def hashed(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For every piece and every n in ``sizes`` (ascending) the n-grams' buckets of ``2 ** bits``.

    An n-gram that lies in the overlap of two pieces may come twice.
    """
    shift = np.uint32(32 - bits)
    for points in pieces(text, sizes[-1]):
        h = np.zeros(len(points), dtype=np.uint32)
        done = 0
        for n in sizes:
            while done < n and len(h):
                done += 1
                h = h[:len(points) - done + 1] * FACTOR + points[done - 1:]
            if len(points) >= n:
                yield ((h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * SPREAD) >> shift
