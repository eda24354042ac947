"""Lines to typed rows.

Each parser adds columns to whatever frame it is given, so it can run after the
id join and only see lines that matter. ``parse_ok`` tells which rows parsed,
``ts_text`` is the timestamp as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.functions import patterns as P
from statetrail.functions.fields import matched_parts, regex_parts
from statetrail.functions.jsontext import comparable, json_object, text_of, unwrap_json, unwrap_paths
from statetrail.functions.let import let, only_if
from statetrail.operators.entities import per_entity
from statetrail.operators.records import settle


def _groups(n: int) -> list[str]:
    return [f"${i}" for i in range(1, n + 1)]


# Every format fills the same slots, in the order of LOG_FIELDS.
LOG_FORMATS = {
    "default": (P.LOG_DEFAULT, _groups(7)),
    "trace": (P.LOG_TRACE, ["$1", "$2", "$3", "$4", "TRACE", "$5", "$6"]),
    "context": (P.LOG_CONTEXT, ["$1", "$2", "$3", "$4", "$5", "$6", "$10", "$7", "$8", "$9"]),
}
SHORTEST = 7


def _slots(names: list[str]) -> list[Column]:
    return [F.get("_hit", F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def parse_db(
    lines: DataFrame, text: str = "value", on_bad_record: str = "fail", strict_fields: bool = False
) -> DataFrame:
    """Audit records: id, timestamp, event, tablename, content.

    The quoted fields are greedy, so quoted text at the start of the content can
    be taken into ``event``; ``strict_fields`` stops each at its closing quote.
    """
    pattern = P.DB_RECORD_STRICT if strict_fields else P.DB_RECORD
    value = F.col(text)
    hit = matched_parts(value, regex_parts(value, pattern, _groups(5)), len(P.DB_FIELDS))
    parsed = settle(lines, hit, on_bad_record, text)
    columns = parsed.select(*lines.columns, "parse_ok", *_slots(P.DB_FIELDS))
    return columns.withColumn("ts_text", F.col("timestamp"))


def log_route(value: Column) -> Column:
    """Format a log line is tried against."""
    return F.when(value.contains("[-]"), "default").when(value.contains("TRACE"), "trace").otherwise("context")


def parse_log(
    lines: DataFrame, text: str = "value", on_bad_record: str = "drop", routing: str = "first"
) -> DataFrame:
    """Log lines: ten fields and the ``format`` that matched, NULL when none did.

    ``routing="first"`` tries only the format the line's text points to, so one
    regex runs per line and a context line that talks about ``[-]`` or ``TRACE``
    is a bad record; ``"any"`` tries the others as well.
    """
    value = F.col(text)
    # the last item names the format
    parts = {name: regex_parts(value, p, [*groups, name]) for name, (p, groups) in LOG_FORMATS.items()}
    if routing == "first":
        route = log_route(value)
        chosen = F.when(route == "default", parts["default"]).when(route == "trace", parts["trace"])
        hit = matched_parts(value, chosen.otherwise(parts["context"]), SHORTEST)
    elif routing == "any":
        hits = [matched_parts(value, p, SHORTEST) for p in parts.values()]
        hit = F.slice(F.concat(*hits), 1, 1)
    else:
        raise ValueError(f"unknown routing {routing!r}")
    parsed = settle(lines, hit, on_bad_record, text)
    named = parsed.withColumn("format", F.element_at("_hit", -1))
    fields = [F.when(F.size("_hit") > i + 2, c).alias(n) for i, (n, c) in enumerate(zip(P.LOG_FIELDS, _slots(P.LOG_FIELDS)))]
    return named.select(*lines.columns, "parse_ok", "format", *fields).withColumn("ts_text", F.col("timestamp"))


def decode_messages(
    lines: DataFrame,
    text: str = "value",
    on_bad_record: str = "fail",
    paths: list[str] | None = None,
) -> DataFrame:
    """Bus messages with JSON inside string values decoded.

    Without ``paths`` every string value at any depth is tried and ``body`` is
    canonical JSON text; one nested deeper than the decoder goes is a bad line. With
    ``paths`` only these top-level keys are, natively,
    and ``body`` is a struct of VARIANTs. A message must be an object with a
    ``timestamp``.
    """
    if paths is None:
        lines_in = lines.withColumn("_body", unwrap_json(F.col(text)))
        whole = F.col("_body")
    else:
        keys = list(dict.fromkeys(["timestamp", *paths]))
        lines_in = lines
        whole = let(
            unwrap_paths(F.col(text), keys),
            lambda b: F.struct(text_of(b["timestamp"]).alias("ts_text"), b.alias("body")),
        )
    parsed = settle(lines_in, only_if(whole, lambda m: m["ts_text"].isNotNull()), on_bad_record, text)
    return parsed.select(*lines.columns, "parse_ok", "_hit.ts_text", "_hit.body")


def parse_states(lines: DataFrame, text: str = "value", on_bad_record: str = "fail") -> DataFrame:
    """VM states: entity_id, ts_text, ``body`` (the whole object as a map of
    VARIANTs) and ``state``, the comparable form of everything but the timestamp."""
    hit = json_object(F.col(text), ["uuid", "timestamp"])
    parsed = settle(lines, hit, on_bad_record, text)
    return parsed.select(
        *lines.columns,
        "parse_ok",
        text_of(F.col("_hit")["uuid"]).alias("entity_id"),
        text_of(F.col("_hit")["timestamp"]).alias("ts_text"),
        F.col("_hit").alias("body"),
        comparable(F.col("_hit"), ["timestamp"]).alias("state"),
    )


def as_ops(parsed: DataFrame, source: str, fields: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Operations in the shape the look-back reads, one for each entity of a line.

    ``payload`` is the JSON text of ``fields``, or the ``body`` of a message. It is made
    before lines with ``entity_ids`` are dealt out to these.
    """
    payload = F.col("body") if fields is None else F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    by = "entity_ids" if "entity_ids" in parsed.columns else "entity_id"
    ops = parsed.select(by, F.lit(source).alias("source"), "ts_text", F.col(seq).alias("seq"), payload.alias("payload"))
    return ops if by == "entity_id" else per_entity(ops).select("entity_id", "source", "ts_text", "seq", "payload")
