"""Texts of an Arrow batch as NumPy arrays: words, their hashes, hashes of runs of words.

Everything here handles a bounded block of texts at a time and is called inside Spark tasks.
Hashes are 64 bits wide and depend on the bytes of the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is a block of its own.
BLOCK_BYTES = 1 << 20

BYTES = np.arange(256)
#: Bytes that separate words: the space and 0x09 to 0x0D.
SPACE = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
#: Bytes inside words of letters and digits: a-z, 0-9 and all of other scripts.
ALNUM = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)
#: A-Z become a-z, all else stays.
LOWER = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 32, BYTES).astype(np.uint8)

BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(x) for x in (30, 27, 31)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> _S[0])) * _M1
    x = (x ^ (x >> _S[1])) * _M2
    return x ^ (x >> _S[2])


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        factors = np.full(size + 1, b, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return up(base), up(pow(base, -1, 1 << 64))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each pair, from one running sum."""
    size = 1 << max(16, int(len(values)).bit_length())
    up, down = _powers(base, size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    lengths = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + lengths * _M2)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and borders of consecutive blocks of texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


class Words:
    """The words of a block: where each begins and ends, and the first word of each text."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, inside: np.ndarray):
        self.data = data
        flag = np.zeros(len(data) + 1, np.int8)
        flag[:-1] = inside[data]
        before = np.zeros(len(data) + 1, np.int8)
        before[1:] = flag[:-1]
        cut = borders[(borders > 0) & (borders < len(data))]
        before[cut] = 0
        self.start = np.flatnonzero((flag == 1) & (before == 0))
        after = flag.copy()
        after[cut] = 0
        last = np.flatnonzero((flag[:-1] == 1) & (after[1:] == 0)) if len(data) else np.zeros(0, np.int64)
        self.end = last + 1
        self.first = np.searchsorted(self.start, borders)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return _spans(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, BYTE_BASE)

    def beginnings(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of the words."""
        end = np.minimum(self.end, self.start + size)
        return _spans(self.data.astype(np.uint64) + np.uint64(1), self.start, end, BYTE_BASE)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes; as many fewer as the last ones don't fill."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(n)
    return _spans(hashes, start, start + length, WORD_BASE)


def run_spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``hashes[start:end]`` for each pair of borders; equal to ``runs`` at equal lengths."""
    return _spans(hashes, start, end, WORD_BASE)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def int64(values: np.ndarray) -> pa.Array:
    """As a BIGINT column, bit by bit."""
    return pa.array(np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.int64))
