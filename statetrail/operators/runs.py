"""Histories as runs of equal states, continued as more rows arrive.

A run is ``(key.., digest, first, last, n)``: the first and last place of the rows it stands
for and their number. Runs that follow each other merge by sums alone, so a stored history
and the runs of new rows make the history of both. Only keys with new rows are looked at, and
of these only runs that the new rows reach and the ones beside them. A run that rows of another
state fall into, late ones, is taken apart into its own rows, which are kept in slim form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.operators.lineage import settle_rounds
from statetrail.operators.slices import changed, running


def _units(rows: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    place = F.struct(*order)
    return rows.select(*key, F.col(digest).alias("digest"), place.alias("first"), place.alias("last"), F.lit(1).cast("bigint").alias("n"))


def merge_runs(units: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """Neighbouring runs of one state put together. Runs that overlap must have the same state."""
    flagged = changed(units, key, ["first"], ["digest"], parts)
    counted = running(flagged, key, ["first"], F.col("_changed").cast("bigint"), "_run", parts)
    merged = counted.groupBy(*key, "_run").agg(
        F.first("digest").alias("digest"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )
    return merged.drop("_run")


def runs_of(rows: DataFrame, key: list[str], order: list[str], digest: str = "digest", parts: int | None = None) -> DataFrame:
    """The runs of rows. Rows of one key must differ in ``order``."""
    return merge_runs(_units(rows, key, order, digest), key, parts)


def history_of(runs: DataFrame) -> DataFrame:
    """The change history: key, digest and the order columns of the first row of each run."""
    return runs.select(*[c for c in runs.columns if c not in ("first", "last", "n")], "first.*", "n")


def extend_runs(
    stored: DataFrame, arrived: DataFrame, stored_rows: DataFrame, arrived_rows: DataFrame, key: list[str], order: list[str],
    digest: str = "digest", parts: int | None = None,
) -> DataFrame:
    """Runs of the stored and the arrived rows together, from the runs of both.

    ``stored_rows`` and ``arrived_rows`` are the slim rows (key, order, digest) of either
    side; of the stored ones only those of keys with a run that is taken apart are read,
    and none if no run is.
    """
    columns = [*key, "digest", "first", "last", "n"]
    whole = F.struct(*key)
    reach = arrived.groupBy(whole.alias("_k")).agg(F.min("first").alias("_low"), F.max("last").alias("_high"))
    placed = stored.withColumn("_k", whole).join(reach, "_k", "left")
    before, after = F.col("last") < F.col("_low"), F.col("first") > F.col("_high")
    beside = placed.where("_low is not null").groupBy("_k").agg(
        F.max(F.when(before, F.col("first"))).alias("_left"), F.min(F.when(after, F.col("first"))).alias("_right")
    )
    # a run beyond the neighbours of what arrived stays; so does all of a key without new rows
    away = F.col("_low").isNull() | (before & (F.col("first") < F.col("_left"))) | (after & (F.col("first") > F.col("_right")))
    told = settle_rounds(placed.join(beside, "_k", "left").select(*columns, F.coalesce(away, F.lit(False)).alias("_away")))
    both = told.where(~F.col("_away")).select(*columns, F.lit(0).alias("side")).unionByName(arrived.select(*columns, F.lit(1).alias("side")))
    span = F.struct("first", "last", "digest")
    for side in (0, 1):
        both = running(both, key, ["first", "side"], F.when(F.col("side") == side, span), f"_at{side}", parts, last=True)
    other = F.when(F.col("side") == 0, F.col("_at1")).otherwise(F.col("_at0"))
    met = settle_rounds(both.withColumn("_met", F.when((other["last"] >= F.col("first")) & (other["digest"] != F.col("digest")), other)))
    hit = met.where("_met is not null")
    torn = settle_rounds(
        hit.select(*key, "side", "first", "last")
        .unionByName(hit.select(*key, (1 - F.col("side")).alias("side"), F.col("_met.first").alias("first"), F.col("_met.last").alias("last")))
        .distinct()
    )
    units = _without(met.select(*columns, "side"), torn, [*key, "side", "first"]).select(*columns)
    if not torn.isEmpty():
        apart = _rows_inside(torn, [stored_rows, arrived_rows], key, order, digest, parts)
        units = units.unionByName(apart.select(*columns))
    merged = merge_runs(units, key, parts)
    return told.where("_away").select(*columns).unionByName(merged.select(*columns))


def _without(rows: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` is not in ``gone``; missing keys are equal inside a struct."""
    name: Column = F.struct(*by)
    return rows.withColumn("_by", name).join(gone.select(name.alias("_by")), "_by", "left_anti").drop("_by")


def _rows_inside(torn: DataFrame, sides: list[DataFrame], key: list[str], order: list[str], digest: str, parts: int | None) -> DataFrame:
    """Rows of the runs that are taken apart, as runs of one.

    Rows and the places where such runs begin are scanned in one order; each row knows the
    last run that began, and belongs to it if it doesn't lie behind its end.
    """
    mark = F.struct("first", "last").alias("mark")
    marks = torn.select(*key, "side", F.col("first").alias("at"), F.lit(0).alias("kind"), mark, F.lit(None).cast("string").alias("digest"))
    none = F.lit(None).cast(marks.schema["mark"].dataType)
    wanted = torn.select(F.struct(*key, "side").alias("_k")).distinct()
    rows = reduce(DataFrame.unionByName, [
        r.select(*key, F.lit(i).alias("side"), F.struct(*order).alias("at"), F.lit(1).alias("kind"), none.alias("mark"), F.col(digest).alias("digest"))
        for i, r in enumerate(sides)
    ])
    own = rows.withColumn("_k", F.struct(*key, "side")).join(wanted, "_k", "left_semi").drop("_k")
    scanned = running(marks.unionByName(own), [*key, "side"], ["at", "kind"], F.col("mark"), "_run", parts, last=True)
    inside = scanned.where((F.col("kind") == 1) & (F.col("at") <= F.col("_run.last")))
    return inside.select(*key, "digest", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(1).cast("bigint").alias("n"))
