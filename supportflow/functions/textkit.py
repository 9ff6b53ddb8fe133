"""Whole-batch tokenising and n-gram hashing with numpy, for use inside Arrow batch steps.

Texts are handled as UTF-8 bytes. Words are maximal runs of word bytes; since every byte of a
non-ASCII character is at least 0x80, the byte classes below mean the same as the code-point
classes. Rows are cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its
own, whole), so the arrays of a step stay bounded by the largest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xD1B54A32D192ED03)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words of ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~SPACES
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text: 0-9, a-z, all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit of a 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(BASE), -1, 1 << 64)
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse modulo 2**64, for ``i < n``."""
    size = 1 << max(12, int(n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


class Words:
    """The words of rows ``[i, j)`` of a column: ``start``, ``end`` (byte positions in
    ``data``), ``row`` (0-based within the chunk), ``hash`` (64 bits, of the word's bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = word[self.data]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        counts = np.searchsorted(self.start, offsets)
        self.per_row = np.diff(counts)
        self.first = counts[:-1]
        self.row = np.repeat(np.arange(len(offsets) - 1), self.per_row)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        return mix((total[self.end] - total[self.start]) * down[self.start] + length * GRAM)


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, valid)`` of the ``size`` consecutive words that start at each word; not valid
    where they would leave the row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        out += hashes[k:k + n] * np.uint64(factor)
        factor = factor * int(GRAM) % (1 << 64)
    return mix(out), row[:n] == row[size - 1:]


def covered(n_words: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that starts at one of ``at``."""
    steps = np.zeros(n_words + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0
