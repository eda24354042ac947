"""Configuration-database snapshots: whole-snapshot and per-record histories.

A snapshot is an object with ``timestamp``, ``IP`` and tables, each of them
``{headings: [..], data: [[cell ..] ..]}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.functions import patterns as P
from statetrail.functions.jsontext import json_object, text_of
from statetrail.functions.let import let
from statetrail.functions import tagged
from statetrail.operators.apart import aggregate_apart, distinct_apart
from statetrail.operators.changes import found_again, slim_changes
from statetrail.operators.records import POLICIES, settle
from statetrail.operators.slices import SLICE, changed_over, ranged


def parse_snapshots(lines: DataFrame, text: str = "value", on_bad_record: str = "fail") -> DataFrame:
    """Add ``host``, ``ts_text`` and ``tables``, a map of VARIANTs."""
    hit = json_object(F.col(text), P.SNAPSHOT_META)
    parsed = settle(lines, hit, on_bad_record, text)
    return parsed.select(
        *lines.columns,
        "parse_ok",
        text_of(F.col("_hit")["IP"]).alias("host"),
        text_of(F.col("_hit")["timestamp"]).alias("ts_text"),
        F.map_filter("_hit", lambda k, v: ~k.isin(P.SNAPSHOT_META)).alias("tables"),
    )


def _headings(table: Column) -> Column:
    return F.try_variant_get(table, "$.headings", "array<string>")


def _data(table: Column) -> Column:
    return F.try_variant_get(table, "$.data", "array<array<variant>>")


def _row_texts(table: Column, ignored: str) -> Column:
    """Rows of a table as arrays of cell texts, one column left out."""

    def texts(skip: Column) -> Column:
        cells = lambda row: F.transform(row, lambda c, i: F.when(skip == i, None).otherwise(F.to_json(c)))
        return F.transform(_data(table), cells)

    # bound once: inside the lambdas it would be looked up for every cell
    return let(F.coalesce(F.array_position(_headings(table), ignored), F.lit(0)) - 1, texts)


def _digest(value: Column) -> Column:
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def snapshot_digest(tables: Column, ignored: str = "statistics") -> Column:
    """SHA-256 of all tables in name order, rows in place, one column left out.

    The digest stands for the snapshot in comparisons, so that shuffles and sorts
    do not compare whole databases.
    """
    entries = F.array_sort(F.map_entries(tables), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    content = F.transform(entries, lambda e: F.struct(e["key"].alias("table"), _row_texts(e["value"], ignored).alias("rows")))
    return _digest(content)


def row_digests(tables: Column, ignored: str = "statistics") -> Column:
    """Array of (table, row_pos, digest of the compared cells), an item per row of every table."""

    def of_table(e: Column) -> Column:
        item = lambda row, i: F.struct(e["key"].alias("table"), i.alias("row_pos"), _digest(row).alias("digest"))
        return F.transform(_row_texts(e["value"], ignored), item)

    found = F.transform(F.map_entries(tables), of_table)
    return F.flatten(F.filter(found, lambda rows: rows.isNotNull()))


def table_rows(snapshots: DataFrame, ignored: str = "statistics") -> DataFrame:
    """A row per table row: table, row_pos and a digest of the compared cells."""
    kept = [c for c in snapshots.columns if c != "tables"]
    return snapshots.select(*kept, F.inline(row_digests(F.col("tables"), ignored)))


def snapshot_changes(
    snapshots: DataFrame, order: list[str] | None = None, whole: bool = True, parts: int | None = None
) -> DataFrame:
    """First snapshot of every run of equal ones per host; added and removed rows
    count. See ``prefix_changes`` for the comparison that ignores those.

    Whole snapshots stay out of the windows; ``seq`` finds the kept ones again. Without
    ``whole`` there are host, order, digest and ``seq`` alone, and nothing is parsed twice.
    """
    digested = snapshots.withColumn("digest", snapshot_digest(F.col("tables")))
    kept = slim_changes(digested, ["host"], order or ["ts_text", "seq"], "digest", ["seq"], parts=parts)
    return found_again(digested, kept, ["seq"]) if whole else kept


def _zip_row(headings: Column, row: Column, distinct: Column) -> Column:
    """Map of column to JSON text, up to the shorter side, last of equal headings.

    ``distinct`` says that no headings are equal, as it is for all rows of a table."""
    plain = (F.size(headings) == F.size(row)) & distinct
    n = F.least(F.size(headings), F.size(row))
    names = F.slice(headings, 1, n)
    entries = F.transform(
        names, lambda name, i: F.struct(name.alias("key"), F.to_json(F.get(row, i)).alias("value"))
    )
    kept = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, n), e["key"]))
    return F.when(plain, F.map_from_arrays(headings, F.transform(row, lambda c: F.to_json(c)))).otherwise(
        F.map_from_entries(kept)
    )


def _cell(headings: Column, row: Column, name: str) -> Column:
    """Cell of the last heading of a name, up to the shorter side; NULL without one."""
    names = F.slice(headings, 1, F.least(F.size(headings), F.size(row)))
    back = F.array_position(F.reverse(names), name)
    return F.get(row, F.when(back > 0, F.size(names) - back).cast("int"))


def expand_snapshots(snapshots: DataFrame, iface: bool = False) -> DataFrame:
    """A row per record of every table: host, ts_text, table, row_pos, record_id and
    ``cols``, a map of column name to cell as JSON text. With ``iface`` also ``iface``, the
    interface id, taken from its cell as it was parsed and not from the text of that again."""
    kept = [c for c in snapshots.columns if c not in ("tables", "value", "parse_ok", "digest")]
    tables = snapshots.select(*kept, F.explode("tables").alias("table", "_table"))
    h = F.col("_headings")
    # what holds for all rows of a table is worked out before they are dealt out
    named = tables.select(*kept, "table", "_table", _headings(F.col("_table")).alias("_headings")).select(
        "*", (F.size(F.array_distinct(h)) == F.size(h)).alias("_distinct"), _from_end(h).alias("_id_at")
    )
    rows = named.select(*kept, "table", "_headings", "_distinct", "_id_at", F.posexplode(_data(F.col("_table"))).alias("row_pos", "_row"))
    return rows.select(
        *kept,
        "table",
        "row_pos",
        _record_id(F.col("_id_at"), F.col("_row")).alias("record_id"),
        _zip_row(h, F.col("_row"), F.col("_distinct")).alias("cols"),
        *([let(_cell(h, F.col("_row"), P.IFACE_COLUMN), lambda v: tagged.map_entry_of(v, P.IFACE_KEY)).alias("iface")] if iface else []),
    )


def _from_end(headings: Column) -> Column:
    """Place of the last ``_uuid`` heading, from 0; NULL without one."""
    back = F.array_position(F.reverse(headings), "_uuid")
    return F.when(back > 0, F.size(headings) - back).cast("int")


def _record_id(at: Column, row: Column) -> Column:
    """Id out of the ``_uuid`` cell, read from the row so that a query for ids does
    not build the columns."""
    return F.try_variant_get(F.get(row, at), "$[1]", "string")


def first_records(records: DataFrame, n: int = 10) -> DataFrame:
    """A look at the earliest records."""
    return records.orderBy("ts_text", "seq", "table", "row_pos").limit(n)


def comparable_cells(cols: Column, ignored: list[str] | None = None) -> Column:
    """Ordered entries without the ignored columns; has equality, unlike the map."""
    skip = P.RECORD_IGNORED if ignored is None else ignored
    return F.sort_array(F.map_entries(F.map_filter(cols, lambda k, v: ~k.isin(skip))))


RECORD_PLACE = ["seq", "table", "row_pos"]


def record_changes(
    records: DataFrame,
    key: list[str] | None = None,
    order: list[str] | None = None,
    ignored: list[str] | None = None,
    on_bad_record: str = "fail",
    carry: list[str] | None = None,
    whole: bool = True,
    parts: int | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """Change history of every record, statistics and injected columns ignored.

    Record ids are taken to be unique over hosts; give ``key`` to add the host. Cells
    are compared by their digest and stay out of the windows. Without ``whole`` there are
    key, order, place and the columns of ``carry`` alone, and nothing is parsed twice.
    With ``only`` there are the rows of ``whole``, with key, order, place and these columns
    alone: they are written with the digests and found again there, not in the lines.
    Records without an id stop the query or, with ``drop`` and ``quarantine``, have no history.
    """
    if on_bad_record == "fail":
        missing = F.raise_error(F.concat(F.lit("record without _uuid: "), F.col("table")))
        records = records.withColumn("record_id", F.coalesce("record_id", missing.cast("string")))
    elif on_bad_record in POLICIES:
        records = records.filter(F.col("record_id").isNotNull())
    else:
        raise ValueError(f"unknown policy {on_bad_record!r}, expected one of {POLICIES}")
    cells = records.withColumn("_cells", _digest(comparable_cells(F.col("cols"), ignored)))
    by = order or ["ts_text", *RECORD_PLACE]
    keys = key or ["record_id"]
    if only is not None:
        narrow = cells.select(*dict.fromkeys([*keys, *by, *RECORD_PLACE, *only, "_cells"]))
        rows = ranged(narrow, keys, by, parts)
        kept = changed_over(rows, by, ["_cells"], parts).filter("_changed")
        return found_again(rows.drop(*SLICE, "_cells"), kept, RECORD_PLACE)
    kept = slim_changes(cells, keys, by, "_cells", RECORD_PLACE, carry, parts).drop("_cells")
    return found_again(records, kept, RECORD_PLACE) if whole else kept


def decode_cells(records: DataFrame) -> DataFrame:
    """Replace the cells of ``cols`` by their decoded structs, values inside them at any depth included."""
    return records.withColumn("cols", tagged.decode_cells(F.col("cols")))


def iface_id(cols: Column) -> Column:
    """Interface id of a record with cells as JSON text, NULL when it has none."""
    return tagged.map_entry(cols[P.IFACE_COLUMN], P.IFACE_KEY)


def with_iface(records: DataFrame, key: str = "record_id", value: Column | None = None) -> DataFrame:
    """All records of the groups of which any record has an interface id; groups without one go."""
    own = iface_id(F.col("cols")) if value is None else value
    having = distinct_apart(records.filter(own.isNotNull()), [key])
    return records.join(having, key, "left_semi")


def rekey(
    records: DataFrame,
    old_key: str = "record_id",
    new_key: Column | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Histories keyed by the first interface id of any of their records.

    Groups without one are dropped. The first id is an aggregate, combined before
    the shuffle, and joined back: no window has to hold a group. ``records`` is read
    twice: hand in what is written, as histories are.
    """
    order = order or ["ts_text", "seq"]
    value = iface_id(F.col("cols")) if new_key is None else new_key
    tagged_ = records.withColumn("_new", value)
    firsts = aggregate_apart(
        tagged_.filter(F.col("_new").isNotNull()),
        [old_key],
        F.min_by("_new", F.struct(*order)).alias("entity_id"),
    )
    return records.join(firsts, old_key)
