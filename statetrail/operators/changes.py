"""Change histories: the first row of every run of equal states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statetrail.operators.slices import changed


def changes(df: DataFrame, key: str | list[str], order: list[str], compare: list[str], parts: int | None = None) -> DataFrame:
    """Rows whose ``compare`` columns differ from the row before in their group.

    The columns must have equality; use a comparable form for maps and VARIANTs.
    A missing value is NULL and equals NULL, also in the key. All columns of ``df`` are
    written once: select those that are needed, or see ``slim_changes``.
    """
    keys = [key] if isinstance(key, str) else key
    return changed(df, keys, order, compare, parts).filter("_changed").drop("_changed")


def slim_changes(
    df: DataFrame, key: list[str], order: list[str], digest: str, place: list[str], carry: list[str] | None = None, parts: int | None = None
) -> DataFrame:
    """As ``changes`` on one ``digest``, for wide rows: only key, order, digest, the columns
    that name a row (``place``) and those of ``carry`` are worked out, once, and written.
    ``found_again`` has the whole rows of those kept."""
    narrow = df.select(*dict.fromkeys([*key, *order, digest, *place, *(carry or [])]))
    return changes(narrow, key, order, [digest], parts)


def found_again(df: DataFrame, kept: DataFrame, place: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``place``, columns that name a row and are never missing, is that of a kept one."""
    there = kept.select(F.struct(*place).alias("_place"))
    return df.withColumn("_place", F.struct(*place)).join(there, "_place", "left_semi").drop("_place")
