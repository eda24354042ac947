"""Packing of documents into windows with their lexical neighbours.

Documents are handled in shards of bounded size, each with an inverted index of its own. A
document's full windows stand alone; what is left of it is to be packed. The next document
not used up seeds a window. Its rarest terms ask the shard's BM25 index, and the unused
documents returned, best first, fill the window; the last one is cut where the window is
full, and its rest waits. So all windows but a shard's last one are full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statetrail.llm import arrays
from statetrail.llm.pieces import PieceTable, split

WINDOW = 1024
#: Documents and bytes of text of a shard; one is closed when either is reached.
SHARD_DOCS, SHARD_BYTES = 2048, 16 << 20
#: Terms of a seed that ask the index, rarest first; BM25's saturation and length normalisation.
TERMS, K1, B = 24, 1.2, 0.75
#: Id behind each document.
END = 0
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def table_of(path: str) -> tuple[PieceTable, re.Pattern | None]:
    """Ids of pieces by the tokenizer at ``path``, and what finds its added tokens; kept by a Python worker from task to task."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    model, added = tokenizer.model, {}
    for i, token in tokenizer.get_added_tokens_decoder().items():
        if token.single_word or token.lstrip or token.rstrip:
            raise ValueError(f"added token {token.content!r}: only tokens that are found as they stand are supported")
        added[token.content.encode()] = i

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[added[p]] if p in added else [t.id for t in model.tokenize(p.decode("latin-1").translate(letters))] for p in pieces]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum())), counts

    # of tokens that begin at one place the longest counts
    found = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    return PieceTable(encode), found


def split_at(data: np.ndarray, borders: np.ndarray, added: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``split``, with each added token of the tokenizer as one piece and a border of the text around it."""
    raw = data.tobytes()
    if added is None or not added.search(raw):
        return split(data, borders)
    spans = [m.span() for i, j in zip(borders, borders[1:], strict=False) for m in added.finditer(raw, i, j)]
    begin, stop = np.array(spans, np.int64).reshape(-1, 2).T
    start, end, _ = split(data, np.unique(np.concatenate([borders, begin, stop])))
    within = np.searchsorted(begin, start, "right") - 1
    inside = (within >= 0) & (start < stop[within]) if len(spans) else np.zeros(len(start), bool)
    kept = ~inside | np.isin(start, begin)
    start, end = start[kept], np.where(inside, stop[within], end)[kept] if len(spans) else end[kept]
    return start, end, np.searchsorted(start, borders)


class Index:
    """BM25 inverted index of a shard, as arrays sorted by term."""

    def __init__(self, terms: list[np.ndarray], times: list[np.ndarray]):
        n = len(terms)
        size = np.fromiter(map(len, terms), np.int64, n)
        doc = np.repeat(np.arange(n), size)
        names, term = np.unique(np.concatenate(terms), return_inverse=True)
        tf = np.concatenate(times).astype(np.float64)
        length = np.bincount(doc, tf, n)
        df = np.bincount(term, minlength=len(names))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(length.mean(), 1e-9)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        # each document's rarest terms that others have too
        shared = np.flatnonzero(df[term] > 1)
        shared = shared[np.lexsort((df[term[shared]], doc[shared]))]
        first = np.searchsorted(doc[shared], np.arange(n + 1))
        self.asks = [term[shared[i : min(i + TERMS, j)]] for i, j in zip(first, first[1:], strict=False)]

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free documents that share a term with the seed, best first, ties in order of the shard."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.asks[seed]]
        if not spans:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), len(free))
        score[seed] = 0
        found = np.flatnonzero((score > 0) & free)
        return found[np.argsort(-score[found], kind="stable")]


class Shard:
    """Documents gathered until the shard is closed."""

    def __init__(self):
        self.ids, self.done, self.rests, self.sizes = [], [], [], []
        self.terms, self.times = [], []
        self.bytes = 0

    def pack(self, sequence: int) -> tuple[list[tuple], int]:
        """Pieces of all documents, and the next free sequence number."""
        rows: list[tuple] = []
        n = len(self.ids)
        if not n:
            return rows, sequence
        left = np.fromiter(map(len, self.rests), np.int64, n)
        free = left > 0
        index = Index(self.terms, self.times)
        waiting = 0
        for seed in range(n):
            if not free[seed]:
                continue
            room = WINDOW

            def take(d: int) -> None:
                nonlocal room
                rest = self.rests[d]
                start, size = len(rest) - left[d], min(left[d], room)
                part = rest[start : start + size]
                rows.append((self.ids[d], int(self.done[d] + start), int(size), zlib.crc32(part.tobytes()), self.sizes[d], sequence, WINDOW - int(room)))
                room -= size
                left[d] -= size
                free[d] = left[d] > 0

            take(seed)
            if room:
                for d in index.neighbours(seed, free):
                    take(d)
                    if not room:
                        break
            while room:
                while waiting < n and not free[waiting]:
                    waiting += 1
                if waiting == n:
                    break
                take(waiting)
            sequence += 1
        return rows, sequence


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents and their places in sequences of at most 1024 tokens.

    A document is the ids of its whole text by the tokenizer at ``path`` (on every machine),
    its added tokens included, and the id 0; a null or empty text is that id alone. A row for each piece: ``start`` in
    the document, ``length``, ``ids_crc32`` of its ids as little-endian unsigned 32-bit
    integers, ``doc_tokens`` of the whole document, ``sequence_id`` and ``offset`` there.
    Each id lies in one piece; sequences that aren't full are padded unless their length is
    a power of two. Rows are packed one by one, also those that share an id; null ids stay null.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, added = table_of(path)
        sequence = TaskContext.get().partitionId() << 40
        shard, rows = Shard(), []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)

        for batch in batches:
            ids_of_docs = batch["doc_id"].to_pylist()
            for row, data, borders in arrays.blocks(batch["text"]):
                start, end, first = split_at(data, borders, added)
                ids, counts, keys, which = table.look_up(data, start, end) if len(start) else (np.zeros(0, np.int64),) * 4
                at = np.concatenate([[0], np.cumsum(counts)])[first]
                n = len(borders) - 1
                owner = np.repeat(np.arange(n), np.diff(first))
                code, times = np.unique(owner * max(len(keys), 1) + which, return_counts=True)
                term_at = np.searchsorted(code, np.arange(n + 1) * max(len(keys), 1))
                for i in range(n):
                    own = np.append(ids[at[i] : at[i + 1]], END).astype("<u4")
                    full = len(own) // WINDOW * WINDOW
                    for begin in range(0, full, WINDOW):
                        rows.append((ids_of_docs[row + i], begin, WINDOW, zlib.crc32(own[begin : begin + WINDOW].tobytes()), len(own), sequence, 0))
                        sequence += 1
                    mine = slice(term_at[i], term_at[i + 1])
                    shard.ids.append(ids_of_docs[row + i])
                    shard.done.append(full)
                    shard.rests.append(own[full:])
                    shard.sizes.append(len(own))
                    shard.terms.append(keys[code[mine] % max(len(keys), 1)].astype(np.uint64))
                    shard.times.append(times[mine])
                shard.bytes += len(data)
                if len(shard.ids) >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                    more, sequence = shard.pack(sequence)
                    rows += more
                    shard = Shard()
                if len(rows) > 10_000:
                    yield out(rows)
                    rows = []
        more, sequence = shard.pack(sequence)
        rows += more
        if rows:
            yield out(rows)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(packed, SCHEMA)
