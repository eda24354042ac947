"""Byte-level BPE, encoded with segment trees over byte positions.

The leaf of a position holds the rank of the pair that starts there, and the root so the
leftmost pair of smallest rank. A merge changes the leaves of the merged position, of its
live left neighbour and of the one it swallows, and the nodes above them. Many pieces of
about one length advance together, one merge each a step, as rows of the same arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statetrail.llm import arrays
from statetrail.llm.pieces import PieceTable, split

#: Leaves of all trees that advance together, at most (one longer piece goes alone).
LEAVES = 1 << 18
NONE = np.int64(1) << 62


class Ranks:
    """A rank file: tokens by rank, and the rank that each mergeable pair of tokens has."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.size = np.zeros(size, np.int64)
        for token, r in self.rank.items():
            self.size[r] = len(token)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.zeros(int(self.size.sum()), np.uint8)
        for token, r in self.rank.items():
            self.flat[self.at[r] : self.at[r] + len(token)] = np.frombuffer(token, np.uint8)
        pairs = {
            (self.rank[t[:i]] << 32) | self.rank[t[i:]]: r
            for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank
        }
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces, and how many each has."""
        known = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        counts = np.where(known >= 0, 1, 0)
        todo = np.flatnonzero(known < 0)
        width = np.array([max(2, 1 << (len(pieces[i]) - 1).bit_length()) for i in todo], np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width):
            same = todo[width == w]
            rows = max(1, LEAVES // int(w))
            for i in range(0, len(same), rows):
                which = same[i : i + rows]
                ids, n = self._merge([pieces[j] for j in which], int(w))
                counts[which] = n
                parts.append((which, ids))
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        whole = known >= 0
        out[at[whole]] = known[whole]
        for which, ids in parts:
            out[np.repeat(at[which], counts[which]) + arrays.ragged(counts[which])] = ids
        return out, counts

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, a power of two, and how many each has."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        token = np.full((n, width + 1), -1, np.int64)
        row = np.repeat(np.arange(n), size)
        token[row, arrays.ragged(size)] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        i, j = np.nonzero(token[:, 1:width] >= 0)
        rank = self.of_pairs(token[i, j], token[i, j + 1])
        tree[i, width + j] = np.where(rank < NONE, rank * width + j, NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            rank, here = np.divmod(tree[row, 1], width)
            gone = after[row, here]
            following = after[row, gone]
            token[row, here], token[row, gone] = rank, -1
            after[row, here] = following
            inside = following < width
            before[row[inside], following[inside]] = here[inside]
            self._set(tree, row, gone, np.full(len(row), NONE), width)
            pair = self.of_pairs(rank, token[row, np.minimum(following, width)])
            self._set(tree, row, here, np.where(pair < NONE, pair * width + here, NONE), width)
            left = before[row, here]
            has = left >= 0
            left, at, r = left[has], row[has], rank[has]
            pair = self.of_pairs(token[at, left], r)
            self._set(tree, at, left, np.where(pair < NONE, pair * width + left, NONE), width)
            row = row[tree[row, 1] < NONE]
        live = token[:, :width] >= 0
        return token[:, :width][live], live.sum(1)

    @staticmethod
    def _set(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        """Leaves of some rows, and the minima on their ways to the roots."""
        node = width + leaf
        tree[row, node] = value
        while width > 1:
            width //= 2
            value = np.minimum(value, tree[row, node ^ 1])
            node = node >> 1
            tree[row, node] = value

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        size = self.size[ids]
        return self.flat[np.repeat(self.at[ids], size) + arrays.ragged(size)]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def table_of(path: str) -> PieceTable:
    """Kept by a Python worker from task to task."""
    return PieceTable(ranks_of(path).encode)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of each row: the ids of the whole text, with the rank file at ``path`` on every machine.

    Null ids stay null; null and empty texts have no ids.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            for row, data, borders in arrays.blocks(batch["text"]):
                ids, at = ids_of_block(table, data, borders)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(at) - 1), lists], names=["doc_id", "ids"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(encoded, "doc_id bigint, ids array<int>")


def ids_of_block(table: PieceTable, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a block, and where those of each text begin."""
    start, end, first = split(data, borders)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    ids, counts, *_ = table.look_up(data, start, end)
    return ids, np.concatenate([[0], np.cumsum(counts)])[first]


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ``ids`` stand for; a null list has none."""
    schema = "doc_id bigint, ids array<int>, decoded binary"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            out = [ranks.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64)).tobytes() for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, schema)


def digest_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: the number of ids, the digest of the ids and that of the bytes decoded from them.

    Null ids stay null; null and empty texts have no ids and the digests of nothing.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks = table_of(path), ranks_of(path)
        for batch in batches:
            for row, data, borders in arrays.blocks(batch["text"]):
                ids, at = ids_of_block(table, data, borders)
                back = ranks.decode(ids)
                back_at = np.concatenate([[0], np.cumsum(ranks.size[ids])])[at]
                raw, n = memoryview(ids.astype("<u4")), len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, n), pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(raw[at[i] : at[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                        pa.array([hashlib.sha256(back[back_at[i] : back_at[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(digested, schema)
