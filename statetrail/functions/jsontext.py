"""JSON text: comparable forms and decoding of JSON nested inside strings."""

from __future__ import annotations

import json
import math
import re
import sys
from functools import reduce
from operator import and_

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from statetrail.functions.let import let

# The decoder travels to the executors itself; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


MAP = "map<string,variant>"


#: Every JSON text; most others are told by it without an exception of the parser.
MAY_BE_JSON = r"^[ \t\r\n]*([\[{\"]|([-+.0-9][-+.0-9eE]*|true|false|null|[-+]?(NaN|INF|Infinity))[ \t\r\n]*\z)"


def as_variant(text: Column) -> Column:
    """VARIANT of a JSON text, NULL when the text as a whole is not JSON.

    The parser stops after the first value. Text inside brackets only parses to
    its end if the text is all there is, or closes the bracket itself, which it
    cannot do for both kinds of bracket.
    """

    def whole(t: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        named = F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}")))
        return let(
            F.when(named.isNotNull(), listed.cast("array<variant>")), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
        )

    # bound first, so that the text is taken out of its VARIANT once
    return let(text, lambda t: F.when(t.rlike(MAY_BE_JSON), whole(t)))


def json_object(text: Column, needs: list[str]) -> Column:
    """Array with the MAP<STRING, VARIANT> of a line that is one JSON object and
    has the needed keys, NULL or empty otherwise.

    Text after the object, a second object and repeated keys make it a bad line.
    """
    listed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), f"array<{MAP}>", {"allowSingleQuotes": "false"}
    )

    def good(entries: Column) -> Column:
        keys = F.map_keys(entries)
        wanted = [text_of(entries[k]).isNotNull() for k in needs]
        return reduce(and_, wanted, F.size(F.array_distinct(keys)) == F.size(keys))

    return let(
        listed, lambda a: F.when((F.size(a) == 1) & F.rtrim(text, F.lit(" \t\r\n")).endswith("}"), F.filter(a, good))
    )


def text_of(value: Column) -> Column:
    """Text of a VARIANT: a string as it is, anything else as JSON."""
    return F.try_variant_get(value, "$", "string")


def comparable(entries: Column, ignored: list[str]) -> Column:
    """Ordered (key, JSON text) array of a MAP<STRING, VARIANT> without some keys.

    MAP and VARIANT have no equality; this form has, whatever the key order.
    """
    kept = F.map_filter(entries, lambda k, v: ~k.isin(ignored))
    pairs = F.transform(
        F.map_entries(kept), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))
    )
    return F.sort_array(pairs)


_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}
_NOT_JSON = object()


def _reject(name: str):
    raise ValueError(name)


def _load(text: str, decode):
    """Value of a JSON text. What cannot be JSON by its first character, which is
    most text, is told without raising an exception."""
    bare = text.strip(" \t\r\n")
    first = bare[:1]
    if first and first in '{["':
        try:
            return decode(bare)
        except (ValueError, RecursionError):
            return _NOT_JSON
    if first and first in "-0123456789":
        if not _NUMBER.fullmatch(bare):
            return _NOT_JSON
        number = decode(bare)
        return _NOT_JSON if isinstance(number, float) and math.isinf(number) else number
    return _WORDS.get(bare, _NOT_JSON)


def _unwrap(value, decode):
    if isinstance(value, str):
        inner = _load(value, decode)
        return value if inner is _NOT_JSON else _unwrap(inner, decode)
    if isinstance(value, dict):
        return {k: _unwrap(v, decode) for k, v in value.items()}
    if isinstance(value, list):
        return [_unwrap(v, decode) for v in value]
    return value


@F.pandas_udf(StructType([StructField("ts_text", StringType()), StructField("body", StringType())]))
def unwrap_json(texts: pd.Series) -> pd.DataFrame:
    """``body``, JSON text with every string value that holds JSON replaced by that
    JSON, and ``ts_text``, its ``timestamp`` as text.

    No built-in expression can follow the nesting. Text that is not a JSON object, or
    nested deeper than the decoder goes, gives NULL.
    """
    # json.loads and json.dumps with options build these anew for every text
    decode = json.JSONDecoder(parse_constant=_reject).decode
    encode = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode

    def one(text):
        try:
            value = _unwrap(text, decode) if isinstance(text, str) else None
            if not isinstance(value, dict):
                return None, None
            ts = value.get("timestamp")
            return (ts if ts is None or isinstance(ts, str) else encode(ts)), encode(value)
        except RecursionError:
            return None, None

    return pd.DataFrame([one(t) for t in texts], columns=["ts_text", "body"], dtype=object)


def unwrap_paths(text: Column, paths: list[str]) -> Column:
    """Native form for known places: struct of VARIANTs, one per top-level key."""

    def places(whole: Column) -> Column:
        found = {p: F.try_variant_get(whole, f"$.{p}", "variant") for p in paths}
        return F.struct(
            *[
                F.coalesce(as_variant(text_of(v)), v).alias(p)
                for p, v in found.items()
            ]
        )

    return let(F.try_parse_json(text), places)
