"""Substring dedup on the graph of token k-mers.

An edge is a run of 20 consecutive words of one text; consecutive edges share 19 words. Two
runs are copies if their words are equal, so everything that repeats is an edge met twice.

Edges travel as path pieces. All edges of a text whose smallest 8-word run (by hash) lies at
the same place form one piece, and equal edges have equal smallest runs; so pieces grouped by
that run hold all occurrences of their edges. Where one content occurs under a run, its
edges don't branch, and every occurrence but the first is a copy as it stands. Where
contents differ, the path branches inside the pieces: one occurrence of each content is
taken apart into edges, which are matched one by one.

Copies are compacted: pieces that continue each other both in the copy and in its source
join into one path. A path is removed only if a digest of its words equals the digest of the
words at the source's coordinates. Texts are dealt out once, and read three times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statetrail.llm import arrays
from statetrail.llm.store import id_of, keyed, with_text

#: Words of an edge, and of the runs whose smallest groups the edges.
EDGE, RUN = 20, 8
#: A content's hash holds the number of its edges, EDGE - RUN + 1 at most, in its last bits.
COUNT_BITS = 4


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each ``width`` consecutive ones."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def _words(data: np.ndarray, borders: np.ndarray) -> arrays.Words:
    return arrays.Words(data, borders, ~arrays.SPACE)


def _pieces(docs: DataFrame) -> DataFrame:
    """``run, content, k, place`` of every path piece; ``place`` is the text's number, then the first edge's word.

    Contents are combined before they travel: in a block of texts only the earliest piece of a
    content looks for partners, the others have it as ``source_k, source_place``. So what many
    texts share, or one text repeats, doesn't gather.
    """
    names = ["run", "content", "k", "place", "source_k", "source_place"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, g = batch["k"].to_numpy(), batch["g"].to_numpy()
            for row, data, borders in arrays.blocks(batch["text"]):
                words = _words(data, borders)
                h = words.hashes()
                if len(h) < EDGE:
                    continue
                small = arrays.runs(h, RUN)
                at = _smallest(small, EDGE - RUN + 1)
                owner = words.owner()
                edge = np.flatnonzero(np.arange(len(at)) + EDGE <= words.first[owner[: len(at)] + 1])
                if not len(edge):
                    continue
                new = np.ones(len(edge), bool)
                new[1:] = (at[edge[1:]] != at[edge[:-1]]) | (edge[1:] != edge[:-1] + 1)
                begin = np.flatnonzero(new)
                start, size = edge[begin], np.diff(np.append(begin, len(edge)))
                content = arrays.run_spans(h, start, start + size + EDGE - 1)
                content = (content >> np.uint64(COUNT_BITS) << np.uint64(COUNT_BITS)) | size.astype(np.uint64)
                of = row + owner[start]
                place = (g[of] << 32) | (start - words.first[owner[start]])
                run, first = small[at[start]], _first_of_block(content, k[of], place)
                copy = (k[of] != k[of][first]) | (place != place[first])
                # a copy needs no partner any more: it goes anywhere, with its source
                run = np.where(copy, arrays.mix(k[of].view(np.uint64) ^ arrays.mix(place.view(np.uint64))), run)
                source = [pa.array(x[first], mask=~copy) for x in (k[of], place)]
                yield pa.RecordBatch.from_arrays(
                    [arrays.int64(run), arrays.int64(content), pa.array(k[of]), pa.array(place), *source], names=names
                )

    return docs.mapInArrow(found, ", ".join(f"{c} bigint" for c in names))


def _first_of_block(content: np.ndarray, k: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each piece of a block, the number of the earliest one of equal content."""
    order = np.lexsort((place, k, content))
    new = np.ones(len(order), bool)
    new[1:] = content[order[1:]] != content[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _items(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Which row each list item is of, and the items."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_parent_indices(column).to_numpy(), column.flatten()


def _edges(texts: DataFrame) -> DataFrame:
    """``edge, k, place`` of each edge of the pieces ``items`` (``place, n``) of texts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch["k"].to_numpy()
            parent, items = _items(batch["items"])
            place, n = items.field("place").to_numpy(), items.field("n").to_numpy()
            for row, data, borders in arrays.blocks(batch["text"]):
                words = _words(data, borders)
                h = arrays.runs(words.hashes(), EDGE)
                lo, hi = np.searchsorted(parent, [row, row + len(borders) - 1])
                if lo == hi:
                    continue
                step = arrays.ragged(n[lo:hi])
                of = np.repeat(parent[lo:hi], n[lo:hi])
                at = np.repeat(place[lo:hi], n[lo:hi]) + step
                word = words.first[of - row] + (at & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([arrays.int64(h[word]), pa.array(k[of]), pa.array(at)], names=["edge", "k", "place"])

    return texts.mapInArrow(found, "edge bigint, k bigint, place bigint")


def _digest(raw: bytes, words: arrays.Words, first: int, edges: int) -> bytes:
    part = raw[words.start[first] : words.end[first + edges + EDGE - 2]]
    return hashlib.blake2b(b" ".join(part.split()), digest_size=16).digest()


def _digests(texts: DataFrame) -> DataFrame:
    """``source_k, source_place, n, digest`` of the words of the paths ``items`` (``place, n``) of texts."""
    names = ["source_k", "source_place", "n", "digest"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, items = _items(batch["items"])
            place, n = items.field("place").to_numpy(), items.field("n").to_numpy()
            for row, data, borders in arrays.blocks(batch["text"]):
                words, raw = _words(data, borders), data.tobytes()
                lo, hi = np.searchsorted(parent, [row, row + len(borders) - 1])
                out = [
                    _digest(raw, words, int(words.first[parent[i] - row] + (place[i] & 0xFFFFFFFF)), int(n[i])) for i in range(lo, hi)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch["k"].take(pa.array(parent[lo:hi])), pa.array(place[lo:hi]), pa.array(n[lo:hi]), pa.array(out, pa.binary())], names=names
                )

    return texts.mapInArrow(found, "source_k bigint, source_place bigint, n bigint, digest binary")


def _cut(texts: DataFrame, row_type: str | None) -> DataFrame:
    """Texts without the words of the paths ``items`` (``place, n, digest``) whose digests are right."""
    names = ["k", "text", "n_words", "n_removed"]
    schema = "k bigint, text string, n_words bigint, n_removed bigint"
    if row_type:
        names.append("row")
        schema += f", row {row_type}"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, items = _items(batch["items"])
            place, n, digest = (items.field(c) for c in ("place", "n", "digest"))
            place, n, digest = place.to_numpy(), n.to_numpy(), digest.to_pylist()
            for row, data, borders in arrays.blocks(batch["text"]):
                count = len(borders) - 1
                words, raw = _words(data, borders), data.tobytes()
                change = np.zeros(len(words) + 1, np.int64)
                lo, hi = np.searchsorted(parent, [row, row + count])
                for i in range(lo, hi):
                    first = int(words.first[parent[i] - row] + (place[i] & 0xFFFFFFFF))
                    if _digest(raw, words, first, int(n[i])) == digest[i]:
                        change[first] += 1
                        change[first + n[i] + EDGE - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (words.counts() > 0) if count else words.counts()
                keep = np.zeros(len(data) + 1, np.int64)
                out = []
                bad = np.flatnonzero(gone)
                stop = np.append(words.start[1:], len(data))[bad] if len(bad) else bad
                owner = words.owner()[bad]
                if len(bad):
                    stop = np.minimum(stop, borders[owner + 1])
                    np.add.at(keep, words.start[bad], 1)
                    np.add.at(keep, stop, -1)
                flag = np.cumsum(keep[:-1]) == 0
                for i in range(count):
                    part = slice(borders[i], borders[i + 1])
                    out.append(raw[part] if not removed[i] else data[part][flag[part]].tobytes())
                columns = [
                    batch["k"].slice(row, count), pa.array(out, pa.binary()).cast(pa.string()), pa.array(words.counts()),
                    pa.array(removed.astype(np.int64)),
                ]
                if row_type:
                    columns.append(batch["row"].slice(row, count))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(found, schema)


def _gathered(rows: DataFrame, k: str, place: str, *fields: str) -> DataFrame:
    """``k, g, items``: the distinct places of each text, in order, with further fields."""
    item = F.struct(F.col(place).alias("place"), *fields)
    return rows.groupBy(F.col(k).alias("k"), F.shiftright(place, 32).alias("g")).agg(F.sort_array(F.collect_set(item)).alias("items"))


def copied_paths(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """``k, place, n, source_k, source_place``: maximal paths of ``n`` edges that also start earlier."""
    here = F.struct("k", "place")
    same = Window.partitionBy("run", "content")
    # dealt out once for both windows and for both uses of the result
    pieces = _pieces(docs).repartition("run").select("*", F.min(here).over(same).alias("first"))
    run = Window.partitionBy("run")
    pieces = pieces.select("*", (F.min("content").over(run) != F.max("content").over(run)).alias("branches"))
    pieces = pieces.withColumn("n", F.col("content").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)))
    source = [F.col("first.k").alias("source_k"), F.col("first.place").alias("source_place")]
    # both uses read both columns, so that they share one shuffle
    known = F.coalesce("source_k", "source_place").isNotNull()
    either = [F.when(known, F.col(c)).otherwise(f).alias(c) for c, f in zip(("source_k", "source_place"), (F.col("first.k"), F.col("first.place")), strict=True)]
    whole = pieces.where(known | (here != F.col("first"))).select("k", "place", "n", *either)
    branching = pieces.where(~known & (here == F.col("first")) & F.col("branches"))
    edges = _edges(dealt.join(_gathered(branching, "k", "place", "n"), ["k", "g"]).select("k", "text", "items"))
    edges = edges.select("*", F.min(here).over(Window.partitionBy("edge")).alias("first"))
    single = edges.where(here != F.col("first")).select("k", "place", F.lit(1).cast("bigint").alias("n"), *source)
    copies = whole.unionByName(single).withColumn("g", F.shiftright("place", 32)).repartition("k", "g")
    order = Window.partitionBy("k", "g").orderBy("place")
    before = {c: F.lag(c).over(order) for c in ("place", "n", "source_k", "source_place")}
    goes_on = (
        (before["place"] + before["n"] == F.col("place")) & (before["source_k"] == F.col("source_k"))
        & (before["source_place"] + before["n"] == F.col("source_place"))
    )
    chained = copies.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("new").over(order))
    return chained.groupBy("k", "g", "path").agg(
        F.min("place").alias("place"), F.sum("n").alias("n"), F.min("source_k").alias("source_k"), F.min("source_place").alias("source_place")
    ).drop("g", "path")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: each text without the words of runs of 20 that also start earlier.

    Words are what stands between white space (0x20, 0x09 to 0x0D). Earlier is a smaller id,
    of equal ids a smaller hash of the text, of one text a smaller place; runs are judged on
    the input. Removed words go with the white space behind them. A null id counts as the
    smallest, a null text as empty: it has no words. Rows equal in id and text are one
    document and get the same result; every row of ``docs`` gives one, with its other columns
    in ``row`` if ``rows`` is set.
    """
    whole = keyed(docs, id_col, text_col, rows).withColumn("g", F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))).drop("h")
    dealt = whole.select("k", "g", "text").repartition("k", "g")
    paths = copied_paths(whole.select("k", "g", "text"), dealt)
    wanted = _gathered(paths, "source_k", "source_place", "n")
    digests = _digests(dealt.join(wanted, ["k", "g"]).select("k", "text", "items"))
    checked = paths.join(digests, ["source_k", "source_place", "n"])
    gone = _gathered(checked, "k", "place", "n", "digest")
    texts = whole.repartition("k", "g") if rows else dealt
    kind = whole.schema["row"].dataType.simpleString() if rows else None
    none = F.array().cast("array<struct<place:bigint,n:bigint,digest:binary>>")
    joined = texts.join(gone, ["k", "g"], "left").select("k", "text", F.coalesce("items", none).alias("items"), *(["row"] if rows else []))
    return _cut(joined, kind).withColumn("doc_id", id_of(F.col("k"))).drop("k")


def words_joined(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    return F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))


def substring_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and the texts that ``dedup_substrings`` leaves; a document left without any word goes."""
    out = dedup_substrings(docs, rows=True)
    some = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))
    return out.where(some).select(*with_text("row", docs.columns, F.col("text")))
