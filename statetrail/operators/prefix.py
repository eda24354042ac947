"""Snapshot changes that ignore rows added or removed at the end of a table.

A snapshot differs from the kept one before it when some row both have, at the
same place of the same table, differs. That relation is not transitive, so the
row before is not enough: the kept snapshot matters. It is found without walking
the snapshots in order. For every table row the next place where that row reads
differently is known from the row's own history; the earliest over the rows of a
snapshot is the snapshot that would replace it. Following these pointers from the
first snapshot of a host gives the kept ones: inside each range of places as they
come, and from range to range by the few places where a pointer can come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statetrail.operators.lineage import settle_rounds
from statetrail.operators.slices import SLICE, changed_over, dealt, next_flagged_over, numbered, ranged, ranges
from statetrail.operators.snapshots import row_digests

CELL = ["host", "table", "row_pos"]


def prefix_changes(snapshots: DataFrame, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """First snapshot of a host and each one that replaces the kept one before.

    ``seq`` names a snapshot; one that comes twice has two places. Digests are worked out once and written,
    and once more with their places; whole snapshots are only read again for those kept.
    """
    order = order or ["ts_text", "seq"]
    names = list(dict.fromkeys(["host", *order, "seq"]))
    slim = snapshots.select(*names, row_digests(F.col("tables")).alias("_rows"))
    placed = settle_rounds(numbered(slim, ["host"], order, parts).select("host", "seq", "pos", "_rows"))
    # rows without a host are in no history
    known = placed.filter("host is not null")
    # not joined by name: a name that comes twice would give each of its places all rows of both
    rows = known.filter("seq is not null").select("host", "pos", F.inline("_rows")).select(*CELL, "pos", "digest")
    reached = _follow(known.select("host", "pos").filter("pos = 1"), _pointers(rows, parts), parts)
    # merged, since Spark takes what was parsed for far smaller than it is and would broadcast it
    kept = known.select("host", "pos", "seq").join(reached.hint("merge"), ["host", "pos"], "left_semi").select("seq")
    return snapshots.join(kept, "seq", "left_semi")


def _pointers(rows: DataFrame, parts: int | None) -> DataFrame:
    """(host, pos, next): where the snapshot at ``pos`` would be replaced."""
    # both scans go over the same ranges, which are worked out once
    held = ranged(rows, CELL, ["pos"], parts)
    flagged = settle_rounds(changed_over(held, ["pos"], ["digest"], parts).drop("digest"))
    ahead = next_flagged_over(flagged, "pos", "_changed", parts)
    return ahead.groupBy("host", "pos").agg(F.min("_next").alias("next")).filter("next is not null")


def _follow(start: DataFrame, pointers: DataFrame, parts: int | None) -> DataFrame:
    """Places reached from the start, some twice.

    Pointers are written once and dealt to ranges of places. Those that lead out of a range to one place
    all come from one run of some table row, so the places where they come in are at most as many as a
    border has such runs. From each of these a task tells where the chain leaves its range; these hops are
    followed from range to range, and then the pointers inside the ranges from where they were entered.
    """
    held, placed = ranges(pointers, ["host"], ["pos"], parts)
    rows = placed(held)
    end = F.max("pos").over(Window.partitionBy(*SLICE))
    out = dealt(rows, parts).withColumn("_end", end).filter("next > _end").select("host", F.col("next").alias("pos"))
    entries = settle_rounds(start.union(out).distinct())
    kind = held.select("host", "pos", "next").schema

    def walked(marks: DataFrame, steps, ascending: bool) -> DataFrame:
        """``steps`` over the rows of each range, a mark before the pointer of its place or, descending, behind it."""
        marked = placed(marks.withColumn("next", F.lit(None).cast("bigint"))).select(rows.columns)
        by = [F.col(c) if ascending else F.desc_nulls_last(c) for c in ("pos", "next")]
        return dealt(rows.union(marked), parts).sortWithinPartitions(*SLICE, *by).select("_part", *kind.names).mapInArrow(steps, kind)

    entered = _chained(start, settle_rounds(walked(entries, _exits, False)))
    return entered.union(walked(entered, _inside, True).select("host", F.col("next").alias("pos")))


def _walk(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    """Rows (host, pos, next) that ``step(known, pos, next)`` gives for the rows of each range and host, in
    turn; ``known`` is a dict of its own for each of these."""
    of, known = None, {}
    for batch in batches:
        part, host, pos, next_ = (batch.column(i).to_pylist() for i in range(4))
        found = []
        for p, h, at, to in zip(part, host, pos, next_):
            if of != (p, h):
                of, known = (p, h), {}
            end = step(known, at, to)
            if end is not None:
                found.append((h, at, end))
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, batch.schema.field(i + 1).type) for i, c in enumerate(columns)], names=batch.schema.names[1:]
        )


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each mark (a row without ``next``) the place behind its range, or the last one, that its chain comes to."""

    def step(ends: dict, at: int, to: int | None) -> int | None:
        if to is None:
            return ends.get(at)
        ends[at] = ends.get(to, to)
        return None

    return _walk(batches, step)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pointers on the chains that begin at the marks."""

    def step(goal: dict, at: int, to: int | None) -> int | None:
        if to is None or goal.pop(at, False):
            goal[at if to is None else to] = True
            return to
        return None

    return _walk(batches, step)


def _chained(start: DataFrame, pointers: DataFrame) -> DataFrame:
    """Places reached from the start; doubles the reach of the pointers each round,
    so a chain over a thousand ranges takes ten rounds. Ends when none is left."""
    kept = settle_rounds(start)
    while not pointers.isEmpty():
        reached = kept.join(pointers, ["host", "pos"]).select("host", F.col("next").alias("pos"))
        kept = settle_rounds(kept.union(reached).distinct())
        onward = pointers.select("host", F.col("pos").alias("next"), F.col("next").alias("_onward"))
        pointers = settle_rounds(
            pointers.join(onward, ["host", "next"]).select("host", "pos", F.col("_onward").alias("next"))
        )
    return kept
