"""Words and their 64-bit hashes from Arrow text columns, by numpy over the raw UTF-8 bytes.

No Python string is made: a slice of rows is one byte array with row offsets, words are runs of a
byte class, and a word's hash is a polynomial over random byte values, taken from prefix sums.
Slices hold about ``limit`` bytes, or one row where that is longer, so memory follows the
longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
ROOT = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Bytes of words made of letters: ASCII letters and all bytes of longer characters.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[65:91] = LETTERS[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ROOT))


class Powers:
    """Powers of the root and of its inverse, as many as the longest slice so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, ROOT, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(ROOT, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of each run of bytes of class ``of``; runs end at the ends of rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = of[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    up, down = POWERS(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(ROOT))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` bytes, by start."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    start = np.arange(len(data) - width + 1)
    return word_hashes(data, start, start + width)
