"""Pieces that a text is split into before the merges of a byte-level BPE, and a table of their ids.

Splitting follows the pattern of the public tokenizers,
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
on arrays of code points instead of match by match. Pieces repeat a lot, so each distinct
one is encoded once in a Python worker and looked up by its 64-bit hash from then on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from statetrail.llm import arrays

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pieces that a worker remembers at most; then it begins anew.
REMEMBERED = 2_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = regex.findall(pattern, text)
        out[np.fromiter(map(ord, found), np.int64, len(found))] = kind
    return out


def split(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece in the bytes of a block of texts, and the first piece of each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(borders), np.int64)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at[1:])
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, borders)] = True
    kind = _classes()[point]
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    change[0] = True
    run = np.flatnonzero(change)
    stop = np.append(run[1:], n)
    spaces = kind[run] == SPACE
    begins = np.zeros(n + 1, bool)
    # a space before a run of another class belongs to it; other white space ends before its last one
    solid = run[~spaces]
    attached = (solid > 0) & (point[solid - 1] == 0x20) & ~edge[solid]
    begins[solid - attached] = True
    blank, blank_stop = run[spaces], stop[spaces]
    begins[blank] = True
    followed = ~edge[blank_stop] & (blank_stop < n) & (blank_stop - blank > 1)
    begins[blank_stop[followed] - 1] = True
    # contractions: a lone apostrophe that no space precedes, then certain letters
    lone = (point[solid] == 0x27) & (stop[~spaces] - solid == 1) & ~attached
    first = solid[lone] + 1
    first = first[first < n]
    first = first[~edge[first]]
    if len(first):
        c = point[first]
        more = np.minimum(first + 1, n - 1)
        second = np.where((first + 1 < n) & ~edge[more], point[more], 0)
        one = np.isin(c, [ord(x) for x in "stmd"])
        two = ((c == ord("r")) | (c == ord("v"))) & (second == ord("e")) | (c == ord("l")) & (second == ord("l"))
        hit = one | two
        first, size = first[hit], np.where(one, 1, 2)[hit]
        begins[first] = False
        after = first + size
        inner = (after < n) & (kind[np.minimum(after, n - 1)] == LETTER)
        begins[after[inner]] = True
    begins[np.flatnonzero(edge[:-1])] = True
    begin = np.flatnonzero(begins[:n])
    start = at[begin]
    return start, np.append(start[1:], at[n]), np.searchsorted(start, borders)


class PieceTable:
    """Ids of pieces, each distinct piece encoded once by ``encode`` (pieces to flat ids and their counts)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.used = 0
        self.at = np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids, counts = self.encode(pieces)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, len(ids), 1 << 16) + len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        numbers = len(self.at) - 1 + np.arange(len(keys))
        self.at = np.concatenate([self.at, self.used + np.cumsum(counts)])
        self.used += len(ids)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, where, keys), np.insert(self.number, where, numbers)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Flat ids of consecutive pieces, how many each has, the distinct hashes and which of them each piece has."""
        if len(self.keys) > REMEMBERED:
            self.clear()
        hashes = arrays._spans(data.astype(np.uint64) + np.uint64(1), start, end, arrays.BYTE_BASE)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[start[i] : end[i]] for i in first[new]])
            place = np.searchsorted(self.keys, keys)
        number = self.number[place][inverse]
        counts = self.at[number + 1] - self.at[number]
        return self.ids[np.repeat(self.at[number], counts) + arrays.ragged(counts)], counts, keys, inverse
