"""What to do with lines that do not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.functions.let import let

POLICIES = ("fail", "drop", "quarantine")


def settle(df: DataFrame, hit: Column, policy: str, text: str = "value") -> DataFrame:
    """Add ``_hit``, the parsed value, and ``parse_ok``.

    ``hit`` is an array that is empty when the line did not parse. ``fail`` stops
    the query at the first such line, ``drop`` removes it and ``quarantine``
    keeps it, flagged, for the caller to split off.

    All three are a generator: it runs where it stands, above the id join, so
    lines that mention no wanted entity never reach it, and filters on its output
    do not move below it and parse again.
    """
    if policy == "quarantine":
        return df.withColumn("_hit", F.explode_outer(hit)).withColumn("parse_ok", F.col("_hit").isNotNull())
    if policy == "fail":
        message = F.concat(F.lit("line does not parse: "), F.coalesce(F.col(text), F.lit("NULL")))
        hit = let(hit, lambda h: F.when(F.size(h) > 0, h).otherwise(F.raise_error(message)))
    elif policy != "drop":
        raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")
    return df.withColumn("_hit", F.explode(hit)).withColumn("parse_ok", F.lit(True))
