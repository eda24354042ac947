"""Ranked lexical search: an inverted index in shards, walked partly by term and partly by document.

The index is built once. A shard holds the postings of some documents as flat arrays, sorted
by term, the documents of a term in order. A query's short lists are walked term by term:
their scores are summed into one accumulator for each document. The accumulators are then
one more list, with the largest of them as its bound, beside the long lists, and all are
walked by document: a block of consecutive documents at a time, skipped when the sum of the
largest scores that its lists have there can't reach the k-th best score so far; within a
block lists are added by falling bound until the rest can't lift a document that far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statetrail.llm import arrays
from statetrail.llm.store import SMALLEST, id_of, settle

#: Bytes of text of a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Distinct terms of the items that are searched at once, about.
BLOCK_TERMS = 1 << 19
#: Documents of a block, and the share of a shard's documents that a short list has at most.
BLOCK, SHORT = 64, 1 / 16
#: Parts that the results of an item are merged in before they meet.
PARTS = 32
#: Bytes of terms: letters and digits, and all beyond ASCII.
INDEX = "docs bigint, terms bigint, names binary, at binary, doc binary, times binary, ids binary, sizes binary"
KINDS = {"names": np.uint64, "at": np.int64, "doc": np.int32, "times": np.int32, "ids": np.int64, "sizes": np.int64}


def _terms(batch: pa.RecordBatch, limit: int = arrays.BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each block of texts: first row, rows, the text, hash and number of times of each of its terms, bytes."""
    for row, data, borders in arrays.blocks(batch["text"], limit):
        words = arrays.Words(arrays.LOWER[data], borders, arrays.ALNUM)
        owner, term = words.owner(), words.hashes()
        order = np.lexsort((owner, term))
        owner, term = owner[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        yield row, len(borders) - 1, owner[start], term[start], np.diff(np.append(start, len(term))), len(data)


class _Shard:
    """Postings gathered until the shard is closed."""

    def __init__(self):
        self.ids, self.doc, self.term, self.times, self.docs, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, times: np.ndarray, size: int) -> None:
        # documents without a term are in no list and don't count
        held, doc = np.unique(owner, return_inverse=True)
        self.ids.append(ids[held])
        self.doc.append(doc + self.docs)
        self.term.append(term)
        self.times.append(times)
        self.docs += len(held)
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        doc, term, times = (np.concatenate(x) for x in (self.doc, self.term, self.times))
        order = np.lexsort((doc, term))
        doc, term, times = doc[order], term[order], times[order]
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        start = np.flatnonzero(new)
        sizes = np.bincount(doc, times, self.docs).astype(np.int64)
        held = {
            "names": term[start], "at": np.append(start, len(term)), "doc": doc, "times": times,
            "ids": np.concatenate(self.ids), "sizes": sizes,
        }
        columns = [pa.array([self.docs], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        columns += [pa.array([held[n].astype(k).tobytes()], pa.binary()) for n, k in KINDS.items()]
        return pa.RecordBatch.from_arrays(columns, names=["docs", "terms", *KINDS])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of all terms of all texts, a row for each shard; to be written before it is searched.

    Null texts have no term, null ids are the smallest id, rows that share an id are
    documents by themselves. Terms are named by 64-bit hashes.
    """

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for row, count, owner, term, times, size in _terms(batch, min(shard_bytes, arrays.BLOCK_BYTES)):
                shard.add(ids[row : row + count], owner, term, times, size)
                if shard.bytes >= shard_bytes:
                    if shard.docs:
                        yield shard.row()
                    shard = _Shard()
        if shard.docs:
            yield shard.row()

    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(SMALLEST)).alias("doc_id")
    return docs.select(key, F.col(text_col).cast("string").alias("text")).mapInArrow(built, INDEX)


def _arrays(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: np.frombuffer(batch[n][i].as_buffer(), KINDS[n]) for n in names}


def weigh(docs: int, found: np.ndarray) -> np.ndarray:
    """Weight of terms that ``found`` of ``docs`` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in found], np.int64)


class Lists:
    """Posting lists of a shard for the terms that are asked for, with the score that each posting adds."""

    def __init__(self, held: dict[str, np.ndarray], terms: np.ndarray, weights: np.ndarray, docs: int, total: int):
        self.ids = held["ids"]
        self.count = len(self.ids)
        names, at = held["names"], held["at"]
        place = np.minimum(np.searchsorted(names, terms), len(names) - 1)
        self.known = np.flatnonzero((names[place] == terms) & (weights > 0))
        place = place[self.known]
        size = at[place + 1] - at[place]
        self.at = np.concatenate([[0], np.cumsum(size)])
        posting = np.repeat(at[place], size) + arrays.ragged(size)
        self.doc, times = held["doc"][posting], held["times"][posting].astype(np.int64)
        norm = 100 - 25 + 25 * held["sizes"] * docs // total
        gain = 1_000_000_000 * times // (1000 * times + 12 * norm[self.doc])
        self.score = gain * np.repeat(weights[self.known], size)
        #: Number of the list of each term that is asked for, -1 without one.
        self.of = np.full(len(terms), -1)
        self.of[self.known] = np.arange(len(self.known))
        self.blocks = -(-self.count // BLOCK)
        # borders of the blocks in each list, and the largest score that the list has in each block
        lists = np.repeat(np.arange(len(self.known)), size)
        cell = lists * self.blocks + self.doc // BLOCK
        self.skip = np.searchsorted(cell, np.arange(len(self.known) * self.blocks + 1)).astype(np.int64)
        self.top = np.zeros(len(self.known) * self.blocks, np.int64)
        filled = np.flatnonzero(np.diff(self.skip))
        if len(filled):
            self.top[filled] = np.maximum.reduceat(self.score, self.skip[filled])
        self.top = self.top.reshape(len(self.known), self.blocks)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Scores the documents of the shard for one item and gives those that count to ``best``."""
        own = self.of[terms]
        times, own = times[own >= 0], own[own >= 0]
        if not len(own):
            return
        size = self.at[own + 1] - self.at[own]
        short = size <= max(1, int(self.count * SHORT))
        summed = np.zeros(self.blocks * BLOCK, np.int64)
        for i, n in zip(own[short], times[short], strict=True):
            part = slice(self.at[i], self.at[i + 1])
            summed[self.doc[part]] += self.score[part] * n
        long, by = own[~short], times[~short]
        tops = self.top[long] * by[:, None]
        order = np.argsort(-tops.max(axis=1, initial=0), kind="stable")
        long, by, tops = long[order], by[order], tops[order]
        # what the lists from the i-th on add at most, in each block
        rest = np.zeros((len(long) + 1, self.blocks), np.int64)
        rest[:-1] = np.cumsum(tops[::-1], axis=0)[::-1]
        bound = summed.reshape(self.blocks, BLOCK).max(axis=1) + rest[0]
        for b in np.flatnonzero(bound >= best.least):
            if bound[b] < best.least:
                continue
            first = b * BLOCK
            score = summed[first : first + BLOCK].copy()
            for j in range(len(long)):
                if score.max() + rest[j, b] < best.least:
                    break
                part = slice(*self.skip[long[j] * self.blocks + b : long[j] * self.blocks + b + 2])
                score[self.doc[part] - first] += self.score[part] * by[j]
            else:
                hit = np.flatnonzero(score >= best.least)
                if len(hit):
                    best.add(self.ids[first + hit], score[hit])


class Best:
    """The best documents of an item so far: larger scores first, then smaller ids."""

    def __init__(self, count: int):
        self.count, self.least = count, 1
        self.ids, self.scores = np.zeros((2, 0), np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.count]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.count:
            self.least = max(1, int(self.scores[-1]))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, text_hash, terms, times``: the terms of each item and how often each is in it; equal rows are one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, count, owner, term, times, _ in _terms(batch):
                order = np.lexsort((term, owner))
                at = np.searchsorted(owner[order], np.arange(count + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["item"].slice(row, count), batch["name"].slice(row, count),
                        pa.ListArray.from_arrays(pa.array(at), arrays.int64(term[order])),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(times[order], pa.int64())),
                    ],
                    names=["item", "name", "terms", "times"],
                )

    text = F.col(text_col).cast("string").alias("text")
    slim = items.select(F.col(id_col).cast("bigint").alias("item"), text).where("text is not null").distinct()
    named = slim.withColumn("name", F.xxhash64("text"))
    cut_up = named.mapInArrow(cut, "item bigint, name bigint, terms array<bigint>, times array<bigint>")
    return cut_up.where(F.size("terms") > 0)


def search(
    index: DataFrame, items: DataFrame, count: int = 20, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``count`` documents of ``index`` that score highest for each item.

    Larger scores come first, then smaller ids; only scores above 0 count. Items are
    searched in blocks of bounded size against all shards. Rows equal in id and text are one
    item, rows that share an id but not the text are several; items without a term have no
    row. ``index`` is read twice for each block: for document counts of the terms, then to
    search. Results of a task are as many as ``count`` times the items of the block.
    """
    spark = index.sparkSession
    asked = settle(item_terms(items, id_col, text_col))
    sizes = asked.agg(F.sum(F.size("terms")).alias("terms")).first()["terms"] or 0
    whole = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    schema = "item_id bigint, name bigint, part int, doc_id bigint, score bigint"
    if not sizes or not whole["docs"]:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    blocks = -(-sizes // block_terms)
    own_block = F.pmod(F.xxhash64(F.lit("block"), "item", "name"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        table = asked.where(own_block == b).toArrow() if blocks > 1 else asked.toArrow()
        if not table.num_rows:
            continue
        flat = table["terms"].combine_chunks().flatten().to_numpy().view(np.uint64)
        terms, which = np.unique(flat, return_inverse=True)
        border = np.concatenate([[0], np.cumsum([len(x) for x in table["terms"]])])
        times = table["times"].combine_chunks().flatten().to_numpy()
        found = spark.sparkContext.broadcast(terms)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = found.value
            total = np.zeros(len(terms), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    held = _arrays(batch, i, ("names", "at"))
                    place = np.minimum(np.searchsorted(held["names"], terms), len(held["names"]) - 1)
                    size = held["at"][place + 1] - held["at"][place]
                    total += np.where(held["names"][place] == terms, size, 0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "docs"])

        counts = index.select("names", "at").mapInArrow(counted, "term bigint, docs bigint")
        counts = counts.groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
        weights = np.zeros(len(terms), np.int64)
        weights[counts["term"].to_numpy()] = weigh(whole["docs"], counts["docs"].to_numpy())
        ids, names = table["item"].to_pylist(), table["name"].to_pylist()
        shared = spark.sparkContext.broadcast((terms, weights, which, times, border, ids, names))
        docs, total = whole["docs"], whole["terms"]

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, weights, which, times, border, ids, names = shared.value
            best = [Best(count) for _ in ids]
            for batch in batches:
                for i in range(batch.num_rows):
                    lists = Lists(_arrays(batch, i, tuple(KINDS)), terms, weights, docs, total)
                    for n, own in enumerate(best):
                        part = slice(border[n], border[n + 1])
                        lists.search(which[part], times[part], own)
            part = TaskContext.get().partitionId() % PARTS
            for n, own in enumerate(best):
                size = len(own.ids)
                if size:
                    columns = [pa.array([x] * size, t) for x, t in ((ids[n], pa.int64()), (names[n], pa.int64()), (part, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(own.ids), pa.array(own.scores)], names=["item_id", "name", "part", "doc_id", "score"]
                    )

        parts.append(index.mapInArrow(searched, schema))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), "doc_id"]
    # partial results of many tasks are cut part by part before those of an item meet
    rows = rows.withColumn("near", F.row_number().over(Window.partitionBy("item_id", "name", "part").orderBy(*order))).where(F.col("near") <= count)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "name").orderBy(*order))).where(F.col("rank") <= count)
    return rows.select("item_id", "rank", id_of(F.col("doc_id")).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, count: int = 20) -> DataFrame:
    """``search`` over an index of ``docs`` that is built and written first."""
    return search(settle(build_index(docs)), items, count)
