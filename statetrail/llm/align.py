"""Alignment of the tokens that two tokenizers cut one text into.

Both cut the same bytes, so a text has two increasing lists of byte offsets where tokens
end. Values of the shorter list are looked up in the longer one by galloping: from where
the value before was found the step doubles until it has passed the value, then a binary
search ends it. Ends that both lists hold cut the tokens into groups; the rank found for
each end, less that of the end before, is the range of tokens that overlap.

Texts are cut into tokens once and written as ids. How often each pair of ids is linked is
counted over all texts. The counts of the most frequent pairs, as many as fit a fixed
bound, travel to the tasks; links of all other pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statetrail.llm import arrays
from statetrail.llm.packing import _byte_letters
from statetrail.llm.pieces import PieceTable, split
from statetrail.llm.store import settle

#: Ends that one lane of the galloping search looks up one after the other.
RUN = 32
#: Pairs whose counts are sent to the tasks, at most (17 bytes each).
KNOWN = 1 << 20
#: Tokens whose bytes are compared with the text at once.
CHECKED = 1 << 18
BLANK = "▁"
MASK = (1 << 32) - 1


class Vocabulary:
    """The bytes of every token: ``data[at[i]:at[i + 1]]`` for id ``i``."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, first: np.ndarray, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Whether the tokens ``first[i]:first[i + 1]`` give the bytes of text ``i``, for each text."""
        size = self.size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        fine = np.diff(end[first]) == np.diff(borders)
        owner = np.repeat(np.arange(len(fine)), np.diff(first))
        for i in range(0, len(ids), CHECKED):
            part = slice(i, i + CHECKED)
            kept = fine[owner[part]]
            token, text = ids[part][kept], owner[part][kept]
            start = end[:-1][part][kept] - end[first[text]] + borders[text]
            step = arrays.ragged(self.size[token])
            same = self.data[np.repeat(self.at[token], self.size[token]) + step] == data[np.repeat(start, self.size[token]) + step]
            fine[np.repeat(text, self.size[token])[~same]] = False
        return fine


@lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[PieceTable, Vocabulary]:
    """The byte-level BPE at ``path``, its added tokens being plain text."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    model, back = tokenizer.model, {c: b for b, c in letters.items()}
    names = tokenizer.get_vocab(with_added_tokens=False)
    tokens = [b""] * (max(names.values(), default=-1) + 1)
    for name, i in names.items():
        tokens[i] = bytes(map(back.__getitem__, name)) if set(name) <= back.keys() else name.encode()

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[t.id for t in model.tokenize(p.decode("latin-1").translate(letters))] for p in pieces]
        return _flat(ids)

    return PieceTable(encode), Vocabulary(tokens)


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> tuple[PieceTable, Vocabulary]:
    """The sentence-piece model at ``path``, which puts a space before a text.

    No piece has a space behind another character, so words are encoded by themselves.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(BLANK in name.lstrip(BLANK) for name in names):
        raise ValueError("a piece goes on behind a space: words can't be encoded by themselves")
    tokens = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]

    alone = [model.piece_to_id(BLANK)]

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # each begins with the space that the model puts there itself, but for an empty text
        ids = model.encode([p[1:].decode() for p in pieces], num_threads=1)
        return _flat([x if len(p) > 1 else alone for p, x in zip(pieces, ids, strict=True)])

    return PieceTable(encode), Vocabulary(tokens)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum())), counts


def blank_split(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the spaces before them: start and end of each, and the first word of each text."""
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[borders[:-1]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(data)), np.searchsorted(start, borders)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """How many values of ``long`` are smaller than each of ``short``, both increasing.

    Every value is searched from where the one before was found, ``RUN`` of them in a
    lane; all lanes advance in step.
    """
    rank = np.empty(len(short), np.int64)
    lanes = np.arange(0, len(short), RUN)
    low = np.zeros(len(lanes), np.int64)
    for step in range(min(RUN, len(short))):
        at = lanes + step
        at = at[at < len(short)]
        value, low = short[at], low[: len(at)].copy()
        high, width = np.full(len(at), len(long)), 1
        going = np.arange(len(at))
        while len(going):
            probe = low[going] + width - 1
            inside = probe < len(long)
            smaller = inside.copy()
            smaller[inside] = long[probe[inside]] < value[going[inside]]
            stopped = inside & ~smaller
            high[going[stopped]] = probe[stopped]
            going, probe = going[smaller], probe[smaller]
            low[going] = probe + 1
            width *= 2
        going = np.flatnonzero(low < high)
        while len(going):
            middle = (low[going] + high[going]) // 2
            smaller = long[middle] < value[going]
            low[going] = np.where(smaller, middle + 1, low[going])
            high[going] = np.where(smaller, high[going], middle)
            going = going[low[going] < high[going]]
        rank[at] = low
    return rank


class Links:
    """Groups and links of two token lists over the same bytes, given where tokens end."""

    def __init__(self, a_end: np.ndarray, b_end: np.ndarray):
        swapped = len(b_end) < len(a_end)
        short, long = (b_end, a_end) if swapped else (a_end, b_end)
        rank = gallop(short, long)
        common = rank < len(long)
        common[common] = long[rank[common]] == short[common]
        first = np.zeros(len(short), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        counts = rank - first + 1
        of_short = np.repeat(np.arange(len(short)), counts)
        of_long = np.repeat(first, counts) + arrays.ragged(counts)
        ends = np.zeros(len(long), bool)
        ends[rank[common]] = True
        #: Whether a group ends with a token, for the tokens of both lists.
        self.a_last, self.b_last = (ends, common) if swapped else (common, ends)
        #: Numbers of the tokens that each link joins.
        self.a, self.b = (of_long, of_short) if swapped else (of_short, of_long)


_DIGITS = 10


def spelled(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each text: ids of its groups; text ``i`` has tokens ``a_at[i]:a_at[i + 1]``."""
    a_group = np.cumsum(a_last) - a_last
    b_group = np.cumsum(b_last) - b_last
    b_before = np.concatenate([[0], np.flatnonzero(b_last) + 1])
    a_until = np.append(np.flatnonzero(a_last) + 1, len(a))
    n = len(a) + len(b)
    ids, ends = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    a_place, b_place = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_until[b_group]
    ids[a_place], ids[b_place] = a, b
    ends[a_place[a_last]], ends[b_place[b_last]] = ord("|"), ord(";")
    digits = np.ones(n, np.int64)
    for i in range(1, _DIGITS):
        digits += ids >= 10**i
    at = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(at[-1], np.uint8)
    out[at[1:] - 1] = ends
    for i in range(int(digits.max(initial=0))):
        has = digits > i
        out[at[1:][has] - 2 - i] = ids[has] // 10**i % 10 + 0x30
    raw, border = out.tobytes(), at[a_at + b_at]
    return [raw[i : max(i, j - 1)] for i, j in zip(border, border[1:], strict=False)]


def _width(vocabulary: Vocabulary) -> type:
    return np.uint16 if len(vocabulary.size) <= 1 << 16 else np.uint32


def tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, a, b``: ids of both tokenizers as little-endian integers, a row for each row of ``docs``.

    The files are on every machine. Ids are empty where a text is null or empty or the
    tokens of either don't spell a space and the text. ``row`` is another number for each row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a_table, a_words), (b_table, b_words) = byte_level(a_path), sentence_pieces(b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, data, borders in arrays.blocks(batch["text"]):
                n = len(borders) - 1
                some = np.flatnonzero(np.diff(borders) > 0)
                spaced = np.insert(data, borders[some], 0x20)
                at = np.concatenate([borders[some], borders[-1:]]) + np.arange(len(some) + 1)
                sides = []
                for table, words, cutter in ((a_table, a_words, split), (b_table, b_words, blank_split)):
                    ids, fine = np.zeros(0, np.int64), np.zeros(0, bool)
                    border = np.zeros(1, np.int64)
                    if len(some):
                        start, end, piece = cutter(spaced, at)
                        ids, counts, _, _ = table.look_up(spaced, start, end)
                        border = np.concatenate([[0], np.cumsum(counts)])[piece]
                        fine = words.spells(ids, border, spaced, at)
                    sides.append((ids.astype(_width(words)), border, fine))
                both = sides[0][2] & sides[1][2]
                columns = []
                for ids, border, _ in sides:
                    raw: list[bytes] = [b""] * n
                    for i in np.flatnonzero(both):
                        raw[some[i]] = ids[border[i] : border[i + 1]].tobytes()
                    columns.append(pa.array(raw, pa.binary()))
                rows = pa.array(np.arange(row, row + n))
                row += n
                yield pa.RecordBatch.from_arrays([rows, batch["doc_id"].slice(first, n), *columns], names=["row", "doc_id", "a", "b"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(cut, "row bigint, doc_id bigint, a binary, b binary")


class _Block:
    """Tokens of a block of rows of ``tokens`` and their links."""

    def __init__(self, batch: pa.RecordBatch, first: int, count: int, sides: tuple[Vocabulary, Vocabulary]):
        self.ids, self.at, ends = [], [], []
        for name, words in zip("ab", sides, strict=True):
            kind = np.dtype(_width(words))
            raw = [x.as_buffer() for x in batch[name].slice(first, count)]
            self.ids.append(np.frombuffer(b"".join(raw), kind).astype(np.int64))
            self.at.append(np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in raw])]).astype(np.int64))
            ends.append(np.cumsum(words.size[self.ids[-1]]))
        self.links = Links(*ends)
        self.codes = self.ids[0][self.links.a] << 32 | self.ids[1][self.links.b]
        self.owner = np.repeat(np.arange(count), np.diff(self.at[0]))


def _blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.RecordBatch, int, int, _Block]]:
    sides = byte_level(a_path)[1], sentence_pieces(b_path)[1]
    for batch in batches:
        # a block ends where its ids of the first tokenizer reach the limit
        for first, _, borders in arrays.blocks(batch["a"], arrays.BLOCK_BYTES // 2):
            yield batch, first, len(borders) - 1, _Block(batch, first, len(borders) - 1, sides)


def pair_counts(cut: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``code, links, best``: how many links join each pair of ids, and whether no pair with its second id has more.

    ``code`` is the first id times 2**32 and the second. Pairs are as many as the
    vocabularies make possible, and counted where they are found before they are dealt out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, block in _blocks(batches, a_path, b_path):
            codes, links = np.unique(block.codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(links, pa.int64())], names=["code", "links"])

    counts = settle(cut.mapInArrow(counted, "code bigint, links bigint").groupBy("code").agg(F.sum("links").alias("links")))
    second = F.col("code").bitwiseAND(F.lit(MASK)).alias("second")
    most = counts.groupBy(second).agg(F.max("links").alias("most"))
    return counts.withColumn("second", second).join(most, "second").select("code", "links", (F.col("links") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[pa.Table, DataFrame | None]:
    """Rows of the most frequent pairs, at most ``most`` of them, and the others (None without any).

    Pairs are told apart by eighths of powers of two of their counts, so no pair has to be ranked.
    """
    level = F.floor(F.log2("links") * 8)
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, edge, rest = 0, None, False
    for at, size in sizes:
        if total + size > most:
            rest = True
            break
        total, edge = total + size, at
    known = counts.where(level >= edge) if edge is not None else counts.limit(0)
    others = (counts if edge is None else counts.where(level < edge)) if rest else None
    return known.toArrow(), others


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, groups: bool = False
) -> DataFrame:
    """Groups and links of the tokens of two tokenizers, a row for each row of ``docs``.

    ``n_a`` and ``n_b`` tokens of the byte-level BPE at ``a_path`` over a space and the text
    and of the sentence pieces at ``b_path`` over the text; ``n_groups`` between byte offsets
    where both end; ``n_links``, pairs of tokens whose bytes overlap; ``n_best`` links whose
    pair of ids has the most links of all pairs with its second id, over all texts;
    ``count_sum`` of the links of their pairs; ``groups_sha256`` of the groups as text, which
    ``groups`` adds. Texts that are null, empty or not spelled by the tokens of both have
    none: zeros and ''. Repeated rows count each time, null ids stay null, other columns
    are not looked at. A text is in the memory of one task with about 60 bytes a byte.
    """
    cut = settle(tokens(docs, a_path, b_path, id_col, text_col))
    table, others = frequent(settle(pair_counts(cut, a_path, b_path)), known)
    order = np.argsort(table["code"].to_numpy(), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("code", "links", "best")))
    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string, rare array<struct<code bigint, times bigint>>"
    names = [c.split()[0] for c in schema.split(", ")[:10]] + ["rare"]
    pair = pa.struct([("code", pa.int64()), ("times", pa.int64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, links, best = shared.value
        for batch, first, n, block in _blocks(batches, a_path, b_path):
            link_of = block.owner[block.links.a]
            at = np.minimum(np.searchsorted(code, block.codes), max(len(code) - 1, 0))
            found = code[at] == block.codes if len(code) else np.zeros(len(block.codes), bool)
            n_best, total = np.zeros((2, n), np.int64)
            np.add.at(n_best, link_of[found], best[at[found]].astype(np.int64))
            np.add.at(total, link_of[found], links[at[found]])
            rare_of, rare = link_of[~found], block.codes[~found]
            by = np.lexsort((rare, rare_of))
            rare_of, rare = rare_of[by], rare[by]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(rare)))
            border = np.searchsorted(rare_of[start], np.arange(n + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(rare[start], pa.int64()), pa.array(times, pa.int64())], fields=list(pair))
            texts = spelled(*block.ids, block.links.a_last, block.links.b_last, *block.at)
            counts = [np.diff(block.at[0]), np.diff(block.at[1]), np.bincount(block.owner[block.links.a_last], minlength=n), np.bincount(link_of, minlength=n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c].slice(first, n) for c in ("row", "doc_id")), *(pa.array(c, pa.int64()) for c in (*counts, n_best, total)),
                    pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]),
                    pa.array([t.decode() if groups else None for t in texts], pa.string()),
                    pa.ListArray.from_arrays(pa.array(border), pairs),
                ],
                names=names,
            )

    rows = cut.mapInArrow(scored, schema)
    wanted = [c for c in names[1:10] if groups or c != "groups"]
    if others is None:
        return rows.select(*wanted)
    rows = settle(rows)
    met = rows.select("row", F.inline("rare")).join(others, "code")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("_best"), F.sum(F.col("times") * F.col("links")).alias("_sum")
    )
    none = F.lit(0).cast("bigint")
    both = rows.join(more, "row", "left")
    both = both.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", none), "count_sum": F.col("count_sum") + F.coalesce("_sum", none)})
    return both.select(*wanted)
