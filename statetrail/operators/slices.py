"""Ordered work on groups of which a few may be huge.

A window over a key puts all rows of that key in one task. Here the rows, written once, are
dealt into ranges of (key, order) of about equal size, whatever the keys: a sample of what
was written places the borders, and a row's range is a function of the row and the borders
alone. The window runs inside (range, key). Only the first and the last key of a range can
go on in another one, so what a row has to know of the ranges before its own is a scan over
two rows a range, which is broadcast: its size is bounded by the number of ranges. The
answer is that of the plain window for every row and any borders.

Missing keys are one group. Keys travel packed in a struct, which compares missing parts as
equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statetrail.functions.search import with_count_not_above
from statetrail.operators.lineage import settle_rounds

#: Rows of the sample for each range, about.
SAMPLED = 100
SLICE = ["_part", "_key"]


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df``, written once, with ``_key`` and ``_part``, the number of its range of (key, order).

    As many ranges as a shuffle has partitions, or ``parts``. Sampling steers only where the
    borders lie.
    """
    held, placed = ranges(df, keys, order, parts)
    return placed(held)


def ranges(
    df: DataFrame, keys: list[str], order: list[str], parts: int | None = None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df``, written once, and what adds ``_key`` and ``_part`` to it and to other rows with its keys and order."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    held = settle_rounds(df.withColumn("_key", key))
    place = F.struct("_key", *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    places = held.select(place.alias("at"))
    share = min(1.0, SAMPLED * parts / max(held.count(), 1))
    kind = places.schema["at"].dataType
    sampled = (places if share == 1.0 else places.sample(share, seed=1)).orderBy("at").select(F.to_json("at").alias("at")).toPandas()["at"]
    borders = [sampled.iloc[len(sampled) * i // parts] for i in range(1, parts)] if len(sampled) else []
    # borders are sorted, so the number of those not above a row is that of its range
    return held, lambda rows: with_count_not_above(rows.withColumn("_key", key), "_part", borders, kind, place)


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of ``ranged``, each range in a task of its own."""
    return rows.repartitionById(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part")


def inside(*order: Column | str):
    """Window over the rows of a key in a range."""
    return Window.partitionBy(*SLICE).orderBy(*order)


def carried(rows: DataFrame, value: Column, fold, descending: bool = False) -> DataFrame:
    """``_part, _key, _carried``: the fold of an aggregate over the ranges before (or after)
    in which the key has rows. A key without any there is not in it.

    ``fold`` is an aggregate of ``_value`` that also works over a window.
    """
    return carried_all(rows, {"_carried": (value, fold)}, descending).where("_carried is not null")


def carried_all(rows: DataFrame, values: dict[str, tuple[Column, Callable]], descending: bool = False) -> DataFrame:
    """As ``carried`` for several values, ``name: (value, fold)``, in one pass over the rows; NULL
    for what a key has not."""
    slices = rows.groupBy(*SLICE).agg(*[value.alias(n) for n, (value, _) in values.items()])
    own = F.struct("_key", *values)
    ends = slices.groupBy("_part").agg(F.min_by(own, "_key").alias("_low"), F.max_by(own, "_key").alias("_high"))
    both = F.when(F.col("_low._key") == F.col("_high._key"), F.array("_low")).otherwise(F.array("_low", "_high"))
    edges = ends.select("_part", F.inline(both))
    direction = F.desc if descending else F.asc
    before = Window.partitionBy("_key").orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(*SLICE, *[fold(F.col(n)).over(before).alias(n) for n, (_, fold) in values.items()])


def _with_carried(rows: DataFrame, ahead: DataFrame, parts: int | None) -> DataFrame:
    return dealt(rows, parts).join(F.broadcast(ahead), SLICE, "left")


def changed(df: DataFrame, keys: list[str], order: list[str], compare: list[str], parts: int | None = None) -> DataFrame:
    """Add ``_changed``: whether a row is the first of its group or differs in any
    ``compare`` column from the row before."""
    return changed_over(ranged(df, keys, order, parts), order, compare, parts).drop(*SLICE)


def changed_over(rows: DataFrame, order: list[str], compare: list[str], parts: int | None = None) -> DataFrame:
    """As ``changed`` over the rows of ``ranged``, for callers that need these or their ranges again."""
    state = F.struct(F.struct(*compare).alias("state"))
    ahead = carried(rows, F.max_by(state, F.struct(*order)), lambda c: F.last(c, ignorenulls=True))
    seen = _with_carried(rows, ahead, parts).withColumn("_before", F.coalesce(F.lag(state).over(inside(*order)), "_carried"))
    moved = F.col("_before").isNull() | ~F.col("_before.state").eqNullSafe(F.struct(*compare))
    return seen.withColumn("_changed", moved).drop("_carried", "_before")


def numbered(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``pos``, the 1-based place of each row in its group."""
    rows = ranged(df, keys, order, parts)
    ahead = carried(rows, F.count(F.lit(1)), F.sum)
    none = F.lit(0).cast("bigint")
    placed = _with_carried(rows, ahead, parts).withColumn("_at", F.row_number().over(inside(*order)))
    return placed.withColumn("pos", F.col("_at") + F.coalesce("_carried", none)).drop(*SLICE, "_at", "_carried")


def next_flagged(df: DataFrame, keys: list[str], place: str, flag: str, parts: int | None = None) -> DataFrame:
    """Add ``_next``, the place of the next flagged row after each row of a group."""
    return next_flagged_over(ranged(df, keys, [place], parts), place, flag, parts).drop(*SLICE)


def next_flagged_over(rows: DataFrame, place: str, flag: str, parts: int | None = None) -> DataFrame:
    """As ``next_flagged`` over rows that have their ranges; these are read twice: hand in what is written."""
    rows = rows.withColumn("_spot", F.when(F.col(flag), F.col(place)))
    behind = carried(rows, F.min("_spot"), F.min, descending=True)
    later = inside(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    seen = _with_carried(rows, behind, parts).withColumn("_here", F.min("_spot").over(later))
    return seen.withColumn("_next", F.coalesce("_here", "_carried")).drop("_spot", "_here", "_carried")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, parts: int | None = None, last: bool = False) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of a group up to each row, itself
    included; with ``last`` the value of the last row up to it that has one."""
    return running_all(df, keys, order, {name: (value, last)}, parts)


def running_all(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Column, bool]], parts: int | None = None, peers: bool = False
) -> DataFrame:
    """As ``running`` for several values, ``name: (value, last)``, over rows that are written and dealt once."""
    return running_over(ranged(df, keys, order, parts), order, values, parts, peers).drop(*SLICE)


def running_over(
    rows: DataFrame, order: list[str], values: dict[str, tuple[Column, bool]], parts: int | None = None, peers: bool = False
) -> DataFrame:
    """As ``running_all`` over the rows of ``ranged``, for callers that need these again. With
    ``peers`` rows of one order, which are in one range, all count as the last of them does."""
    rows = rows.withColumns({f"_of_{n}": v for n, (v, _) in values.items()})
    frame = Window.rangeBetween if peers else Window.rowsBetween
    so_far = frame(Window.unboundedPreceding, 0).partitionBy(*SLICE).orderBy(*order)
    ahead, done = {}, {}
    for n, (_, last) in values.items():
        own = F.col(f"_of_{n}")
        fold = (lambda c: F.last(c, ignorenulls=True)) if last else F.sum
        # ordered inside the aggregate, since a group has no order of its own
        whole = F.max_by(F.struct(own.alias("v")), F.when(own.isNotNull(), F.struct(*order)))["v"] if last else F.sum(own)
        ahead[f"_ahead_{n}"] = (whole, fold)
        here, before = fold(own).over(so_far), F.col(f"_ahead_{n}")
        done[n] = F.coalesce(here, before) if last else F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    seen = _with_carried(rows, carried_all(rows, ahead), parts)
    return seen.withColumns(done).drop(*[f"{x}{n}" for n in values for x in ("_of_", "_ahead_")])
