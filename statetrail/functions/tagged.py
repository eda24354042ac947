"""Tagged cells of a configuration database: ``["uuid",x]``, ``["set",[..]]``, ``["map",[[k,v]..]]``.

Cells without sets, maps or objects inside others are decoded by built-in expressions. No such
expression follows nesting of any depth, so the other cells of a record go to an Arrow
function, all in one value.
"""

from __future__ import annotations

import json
import sys
from json.encoder import encode_basestring

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from statetrail.functions.let import let

# The decoder travels to the executors itself; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECODED = "struct<kind: string, scalar: string, set: array<string>, map: map<string,string>, raw: string>"
#: Brackets that a cell may have inside one another; a JSON parser of Spark goes no deeper either.
DEEPEST = 10_000


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _items(v: Column, kind: str) -> Column:
    return v.try_cast(f"array<{kind}>")


def _leaf(v: Column) -> Column:
    """Text of a value inside a set or map that is not nested: a scalar as it is, the id of a
    reference. A list with an unknown tag has no value."""
    return F.when(_tag(v) == "uuid", F.try_variant_get(v, "$[1]", "string")).when(
        ~_is_array(v), F.try_variant_get(v, "$", "string")
    )


def _last_of_each(pairs: Column) -> Column:
    """Entries whose key does not come again later, so that a map can be built."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(
        F.filter(
            pairs,
            lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]),
        )
    )


class _Number(str):
    """A number as it was written."""


def _tag_of(value) -> str | None:
    pair = isinstance(value, list) and len(value) == 2 and type(value[0]) is str
    return value[0] if pair and value[0] in ("uuid", "set", "map") else None


def _pairs(value) -> dict[str, object]:
    """Entries of the pairs of a map, the last of equal keys; keys are texts as a scalar's is."""
    found = {}
    for p in value if isinstance(value, list) else ():
        if isinstance(p, list) and p and p[0] is not None:
            found[_text(p[0])] = p[1] if len(p) > 1 else None
    return found


def _plain(value):
    """A value with every tag, at any depth, replaced by what it stands for; a list without one is nothing."""
    tag = _tag_of(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if tag == "set":
        return [_plain(v) for v in value[1]] if isinstance(value[1], list) else None
    if tag == "map":
        return {k: _plain(v) for k, v in _pairs(value[1]).items()}
    if tag == "uuid":
        return value[1]
    return None if isinstance(value, list) else value


def _written(value) -> str:
    """JSON text, keys in order, numbers as they were."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_basestring(k)}:{_written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, str):
        return str(value) if isinstance(value, _Number) else encode_basestring(value)
    return json.dumps(value)


def _text(value) -> str | None:
    """Text of a decoded value: a scalar as it is, anything else as JSON."""
    if value is None or isinstance(value, str):
        return value if value is None else str(value)
    return _written(value)


def _decoded_cell(cell: str, load) -> dict:
    try:
        value = load(cell)
    except ValueError:
        return {"kind": "unknown", "raw": cell}
    tag = _tag_of(value)
    if isinstance(value, dict) or tag == "map":
        entries = value if isinstance(value, dict) else _pairs(value[1])
        return {"kind": tag or "object", "map": {k: _text(_plain(v)) for k, v in entries.items()}}
    if tag == "set":
        return {"kind": tag, "set": [_text(_plain(v)) for v in value[1]] if isinstance(value[1], list) else None}
    if tag == "uuid":
        return {"kind": tag, "scalar": _text(value[1])}
    return {"kind": "unknown", "raw": cell} if isinstance(value, list) else {"kind": "scalar", "scalar": _text(value)}


@F.pandas_udf(StringType())
def _deep_cells(records: pd.Series) -> pd.Series:
    """Decoded cells of each record, given and returned as one JSON object of cell texts."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    # json.loads with options builds this anew for every cell
    load = json.JSONDecoder(parse_int=_Number, parse_float=_Number).decode

    def one(text):
        if not isinstance(text, str):
            return None
        return json.dumps({name: _decoded_cell(cell, load) for name, cell in json.loads(text).items()})

    return pd.Series([one(t) for t in records], dtype=object)


def is_nested(cell: Column) -> Column:
    """Whether a cell may have a set, map or object inside another: true for every one that has, and for some texts."""
    return cell.rlike(r'(?s)\{|(\["(set|map)",.*){2}')


def decode_cells(cols: Column) -> Column:
    """A map of decoded cells for a map of cells given as JSON text; see ``decode_tagged``.

    Values inside sets, maps and objects are texts; those that are sets, maps or objects
    again are decoded to JSON, whatever their depth: sets are lists, maps objects with keys
    in order. The last of equal keys counts. A list with an unknown tag or length has no value.
    """
    nested = F.map_filter(cols, lambda k, v: F.coalesce(is_nested(v), F.lit(False)))
    deep = F.from_json(_deep_cells(F.when(F.size(nested) > 0, F.to_json(nested))), f"map<string,{DECODED}>")

    def decoded(found: Column) -> Column:
        return F.transform_values(cols, lambda k, v: F.coalesce(F.try_element_at(found, k), _flat(v)))

    return let(deep, decoded)


def decode_tagged(cell: Column) -> Column:
    """Struct ``(kind, scalar, set, map, raw)`` of a cell given as JSON text.

    ``kind`` is scalar, uuid, set, map, object or unknown. A list that is no tagged pair
    has no value: only ``raw`` keeps it. See ``decode_cells`` for what is inside.
    """
    return let(decode_cells(F.create_map(F.lit("cell"), cell)), lambda m: m["cell"])


def _flat(cell: Column) -> Column:
    """A cell without sets, maps or objects inside others."""
    return let(F.try_parse_json(cell), lambda v: let(_tag(v), lambda tag: _decoded(v, tag, cell)))


def _tag(v: Column) -> Column:
    """Tag of a pair, NULL for anything else."""
    pair = F.when(_is_array(v), _items(v, "variant"))
    return F.when(F.size(pair) == 2, F.try_variant_get(v, "$[0]", "string"))


def _decoded(v: Column, tag: Column, cell: Column) -> Column:
    kind = (
        F.when(tag.isin("uuid", "map", "set"), tag)
        .when(~_is_array(v), "scalar")
        .otherwise("unknown")
    )
    entries = F.transform(
        F.try_variant_get(v, "$[1]", "array<array<variant>>"),
        lambda p: F.struct(
            F.try_variant_get(F.get(p, F.lit(0)), "$", "string").alias("key"),
            _leaf(F.get(p, F.lit(1))).alias("value"),
        ),
    )
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    items = F.transform(F.try_variant_get(v, "$[1]", "array<variant>"), lambda x: _leaf(x))
    return F.struct(
        kind.alias("kind"),
        F.when(tag == "uuid", F.try_variant_get(v, "$[1]", "string"))
        .when(~_is_array(v), F.try_variant_get(v, "$", "string"))
        .alias("scalar"),
        F.when(tag == "set", items).alias("set"),
        F.when(tag == "map", let(named, lambda e: F.map_from_entries(_last_of_each(e)))).alias("map"),
        F.when(kind == "unknown", cell).alias("raw"),
    )


def map_entry(cell: Column, key: str) -> Column:
    """Text of the entry of one key of a tagged map cell, the last of several; NULL when the cell is no map or
    the entry is a set, map or list. No other entry is decoded."""
    return let(F.try_parse_json(cell), lambda v: map_entry_of(v, key))


def map_entry_of(v: Column, key: str) -> Column:
    """As ``map_entry``, of a cell that is a VARIANT: the value of the entry alone becomes text on the way."""
    pairs = F.when(_tag(v) == "map", F.try_variant_get(v, "$[1]", "array<array<variant>>"))
    own = F.filter(pairs, lambda p: F.try_variant_get(F.get(p, F.lit(0)), "$", "string") == key)
    value = F.get(F.try_element_at(own, F.lit(-1)), F.lit(1))
    # read from its text, as a cell is, so that numbers are written alike
    return let(F.try_parse_json(F.to_json(value)), _leaf)
