"""Records of an entity in order of time.

The flat form has a row per record and no limit on the records of an entity. The
nested form packs those of a fixed stretch of time into an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statetrail.operators.apart import aggregate_apart
from statetrail.operators.slices import SLICE, numbered, ranged, running_over

ORDER = ["ts_text", "seq"]
#: Characters of the time that an array of the nested form shares: the day. Records that it has at most.
PART, BLOCK = 10, 10_000


def timeline(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Records brought together by entity and sorted by time, ready to be written.

    Partitioned by ranges of entity and time: the files of a hot entity are cut by
    time and never overlap, a cold one lies in one piece. A sample of the input
    places the borders.
    """
    by = ["entity_id", *(order or ORDER)]
    return records.repartitionByRange(*by).sortWithinPartitions(*by)


def nested_timeline(
    records: DataFrame,
    fields: list[str],
    order: list[str] | None = None,
    part_chars: int = PART,
    parts: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(entity_id, part, block, records)`` with ``records`` sorted by time and numbered
    through all parts by ``pos``.

    ``part`` is the beginning of the time that its records share, the day by default, and
    ``block`` counts each ``block`` records of the entity: fixed rules, so results have the
    same shape at every size, and no array is longer.
    """
    order = order or ORDER
    placed = numbered(records, ["entity_id"], order, parts)
    part = F.substring(F.col(order[0]), 1, part_chars).alias("part")
    item = F.struct("pos", *fields)
    return placed.groupBy("entity_id", part, F.floor((F.col("pos") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("records"))


def history_summary(states: DataFrame, ops: DataFrame) -> DataFrame:
    """Left join of histories and timelines on the entity.

    Both sides are folded to a row per entity first; ``n_ops`` is NULL for an
    entity the operations do not know.
    """
    left = states.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_states"),
        F.min("ts_text").alias("first_state"),
        F.max("ts_text").alias("last_state"),
    )
    right = ops.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_ops"),
        F.min("ts_text").alias("first_op"),
        F.max("ts_text").alias("last_op"),
    )
    return left.join(right, "entity_id", "left")


def history_timeline(states: DataFrame, ops: DataFrame, sources: list[str], parts: int | None = None) -> DataFrame:
    """Left join of histories and timelines, row by row: ``entity_id, ts_text, seq, kind, state, since, n_<source>..``.

    All states and operations of entities that have a state, in one order of time, an
    operation before a state of the same time. Each row has the state that holds then and
    since when (NULL before the first), and how many operations of each source came up to it
    (NULL for an entity without any). Made by one scan, without pairs; ``states`` need a
    ``state`` column. Missing entities are left out.
    """
    text = states.schema["state"].dataType
    none = F.lit(None).cast(text).alias("state")
    events = states.select("entity_id", "ts_text", "seq", F.lit("state").alias("kind"), "state").unionByName(
        ops.select("entity_id", "ts_text", "seq", F.col("source").alias("kind"), none)
    ).where("entity_id is not null").withColumn("_after", F.col("kind") == "state")
    holds = F.when(F.col("_after"), F.struct("state", F.col("ts_text").alias("since")))
    counts = {f"n_{s}": (F.when(F.col("kind") == s, 1).otherwise(0).cast("bigint"), False) for s in sources}
    order = ["ts_text", "_after", "seq"]
    # the written rows serve both, so that histories and operations are made once
    rows = ranged(events, ["entity_id"], order, parts)
    scanned = running_over(rows, order, {"_holds": (holds, True), **counts}, parts).drop(*SLICE)
    known = aggregate_apart(rows, ["entity_id"], F.bool_or("_after").alias("_states"), F.bool_or(~F.col("_after")).alias("_ops"))
    told = scanned.join(known.where("_states"), "entity_id")
    return told.select(
        "entity_id", "ts_text", "seq", "kind", "_holds.state", "_holds.since", *[F.when(F.col("_ops"), F.col(n)).alias(n) for n in counts]
    )
