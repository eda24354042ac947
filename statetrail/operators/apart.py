"""Aggregates that are joined to a frame with hot keys.

Adaptive execution splits the hot partition of a join only if both sides were
shuffled for that join. The result of an aggregate on the join keys is partitioned
by them already and would be taken as it is, hot partition and all on the other
side. Grouping by one thing more, itself a function of the keys, changes no group
but makes the join shuffle the result, which is small, once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _more(keys: list[str]) -> Column:
    return (F.xxhash64(*keys) % 2).alias("_apart")


def aggregate_apart(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggregates)``, for joining on the same keys."""
    return df.groupBy(*keys, _more(keys)).agg(*aggregates).drop("_apart")


def distinct_apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df.select(*keys).distinct()``, for joining on the same keys."""
    return df.select(*keys, _more(keys)).distinct().drop("_apart")
