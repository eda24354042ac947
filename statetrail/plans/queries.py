"""Registered queries: every operator over lines derived from the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statetrail.functions import clock, tagged
from statetrail.functions.patterns import DB_FIELDS, LOG_FIELDS
from statetrail.operators import changes as ch
from statetrail.operators import correlate as co
from statetrail.operators import entities as en
from statetrail.operators import lookback as lb
from statetrail.operators import parse as pa
from statetrail.operators import prefix as pf
from statetrail.operators import slices as sl
from statetrail.operators import snapshots as sn
from statetrail.operators import timeline as tl
from statetrail.operators.lineage import settle_rounds
from statetrail.plans.event_lines import event_lines

DAY = 86_400
#: What the events stand for where states meet operations: every event has one part.
#: Timelines and histories by themselves (entity ``uuid``) read all events in each part.
#: Where fewer sources take part, the events of the others are states as well.
ROLES = {"log": ["click"], "msg": ["purchase"], "db": ["signup"]}
ALL = tuple(ROLES)
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# -- inputs ------------------------------------------------------------------


def supplier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity ids of the suppliers, made like those of the users: some coincide."""
    h = "md5(cast(s_suppkey as string))"
    shape = (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-4'||substr({h},14,3)||'-8'||substr({h},18,3)||'-'||substr({h},21,12)"
    )
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(f"{shape} AS entity_id")


def bare(lines: DataFrame) -> DataFrame:
    """Lines without the commas around them, as the JSON sources deliver them."""
    return lines.withColumn("value", F.btrim("value", F.lit(",\n")))


def role_lines(spark: SparkSession, sf_dir: str, kind: str, entity: str, sources: tuple[str, ...] = ALL) -> DataFrame:
    lines = event_lines(spark, sf_dir, kind, entity)
    if entity == "uuid":
        return lines
    if kind == "state":
        return lines.filter(~F.col("role").isin([r for s in sources for r in ROLES[s]]))
    return lines.filter(F.col("role").isin(ROLES[kind]))


def vm_fields(lines: DataFrame) -> DataFrame:
    return pa.parse_states(lines).select(
        "entity_id",
        "ts_text",
        "seq",
        F.try_variant_get(F.col("body")["status"], "$", "string").alias("status_text"),
        F.try_variant_get(F.col("body")["vcpu"], "$", "bigint").alias("vcpu"),
        "state",
    )


def vm_states(spark: SparkSession, sf_dir: str, entity: str = "vm", sources: tuple[str, ...] = ALL) -> DataFrame:
    return vm_fields(bare(role_lines(spark, sf_dir, "state", entity, sources)))


def vm_changes(spark: SparkSession, sf_dir: str, entity: str = "vm", sources: tuple[str, ...] = ALL) -> DataFrame:
    states = vm_states(spark, sf_dir, entity, sources).drop("vcpu")
    kept = ch.changes(states, "entity_id", ["ts_text", "seq"], ["state"])
    return kept.select("entity_id", "ts_text", "seq", F.col("status_text").alias("state"))


def log_ops(spark: SparkSession, sf_dir: str, entity: str, ids: en.Wanted | None = None) -> DataFrame:
    return pa.as_ops(pa.parse_log(en.match_lines(role_lines(spark, sf_dir, "log", entity), ids)), "log", LOG_FIELDS)


def msg_ops(spark: SparkSession, sf_dir: str, entity: str, ids: en.Wanted | None = None) -> DataFrame:
    lines = bare(role_lines(spark, sf_dir, "msg", entity))
    return pa.as_ops(pa.decode_messages(en.match_lines(lines, ids)), "msg")


def db_ops(spark: SparkSession, sf_dir: str, entity: str, ids: en.Wanted | None = None) -> DataFrame:
    return pa.as_ops(pa.parse_db(en.match_lines(role_lines(spark, sf_dir, "db", entity), ids)), "db", DB_FIELDS)


def all_ops(spark: SparkSession, sf_dir: str, entity: str = "vm") -> DataFrame:
    return co.union_ops([f(spark, sf_dir, entity) for f in (log_ops, msg_ops, db_ops)])


def snapshot_lines(spark: SparkSession, sf_dir: str, kind: str = "snapshot") -> DataFrame:
    return bare(event_lines(spark, sf_dir, kind))


def records_of(lines: DataFrame, iface: bool = False) -> DataFrame:
    return sn.expand_snapshots(sn.parse_snapshots(lines), iface)


def record_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written histories of records, without their cells but for the interface id."""
    records = records_of(snapshot_lines(spark, sf_dir), iface=True)
    return settle_rounds(sn.record_changes(records, carry=["iface"], whole=False))


# -- entity matching ---------------------------------------------------------


@query
def uuid_extract(spark, sf_dir):
    lines = event_lines(spark, sf_dir, "mention")
    return lines.select("seq", F.array_join(en.mentioned(F.col("value")), "|").alias("ids"))


@query
def uuid_explode(spark, sf_dir):
    return en.extract_entities(event_lines(spark, sf_dir, "mention")).select("seq", "entity_id")


@query
def uuid_match(spark, sf_dir):
    ids = supplier_ids(spark, sf_dir)
    return en.match_entities(event_lines(spark, sf_dir, "mention"), ids).select("seq", "entity_id", "value")


@query
def uuid_match_shuffled(spark, sf_dir):
    ids = supplier_ids(spark, sf_dir)
    lines = event_lines(spark, sf_dir, "mention")
    return en.match_entities(lines, ids, broadcast=False).select("seq", "entity_id", "value")


@query
def uuid_lines(spark, sf_dir):
    ids = en.wanted_ids(supplier_ids(spark, sf_dir))
    found = en.match_lines(event_lines(spark, sf_dir, "mention"), ids)
    return found.select("seq", F.array_join("entity_ids", "|").alias("ids"), "value")


@query
def uuid_lines_shuffled(spark, sf_dir):
    ids = en.wanted_ids(supplier_ids(spark, sf_dir), listed_bytes=0)
    found = en.match_lines(event_lines(spark, sf_dir, "mention"), ids)
    return found.select("seq", F.array_join("entity_ids", "|").alias("ids"), "value")


@query
def uuid_match_normalized(spark, sf_dir):
    ids = supplier_ids(spark, sf_dir)
    lines = event_lines(spark, sf_dir, "mention")
    return en.match_entities(lines, ids, normalize=True).select("seq", "entity_id")


@query
def uuid_filter(spark, sf_dir):
    ids = supplier_ids(spark, sf_dir)
    return en.filter_lines(event_lines(spark, sf_dir, "mention"), ids, key=["seq"]).select("seq", "value")


@query
def entity_ids(spark, sf_dir):
    return en.entity_ids(vm_changes(spark, sf_dir, "uuid"))


# -- parsing -----------------------------------------------------------------


@query
def db_parse(spark, sf_dir):
    return pa.parse_db(event_lines(spark, sf_dir, "db")).select("seq", *DB_FIELDS)


@query
def db_parse_strict(spark, sf_dir):
    lines = event_lines(spark, sf_dir, "db")
    return pa.parse_db(lines, strict_fields=True).select("seq", *DB_FIELDS)


@query
def log_parse(spark, sf_dir):
    lines = event_lines(spark, sf_dir, "log")
    parsed = pa.parse_log(lines, on_bad_record="quarantine")
    return parsed.select("seq", "format", *LOG_FIELDS)


@query
def log_wellformed(spark, sf_dir):
    return pa.parse_log(event_lines(spark, sf_dir, "log")).select("seq", "format", "value")


def _one_format(spark, sf_dir, name):
    parsed = pa.parse_log(event_lines(spark, sf_dir, "log"))
    return parsed.filter(F.col("format") == name).select("seq", *LOG_FIELDS)


@query
def log_parse_default(spark, sf_dir):
    return _one_format(spark, sf_dir, "default")


@query
def log_parse_trace(spark, sf_dir):
    return _one_format(spark, sf_dir, "trace")


@query
def log_parse_context(spark, sf_dir):
    return _one_format(spark, sf_dir, "context")


@query
def log_parse_any(spark, sf_dir):
    parsed = pa.parse_log(event_lines(spark, sf_dir, "log"), routing="any")
    return parsed.select("seq", "format", "content", "requestID")


@query
def msg_decode(spark, sf_dir):
    decoded = pa.decode_messages(bare(event_lines(spark, sf_dir, "msg")))
    body = F.try_parse_json("body")
    return decoded.select(
        "seq",
        "ts_text",
        F.try_variant_get(body, "$.event", "string").alias("event"),
        F.try_variant_get(body, "$.body.id", "string").alias("body_id"),
        F.try_variant_get(body, "$.body.n", "bigint").alias("body_n"),
        F.schema_of_variant(F.try_variant_get(body, "$.body.n", "variant")).alias("n_type"),
        "body",
    )


@query
def msg_decode_paths(spark, sf_dir):
    decoded = pa.decode_messages(bare(event_lines(spark, sf_dir, "msg")), paths=["body", "event"])
    return decoded.select(
        "seq",
        "ts_text",
        F.try_variant_get("body.event", "$", "string").alias("event"),
        F.try_variant_get("body.body", "$.id", "string").alias("body_id"),
        F.try_variant_get("body.body", "$.n", "string").alias("body_n"),
    )


@query
def state_parse(spark, sf_dir):
    return vm_states(spark, sf_dir, "uuid").select("entity_id", "ts_text", "seq", "status_text", "vcpu")


# -- timelines ---------------------------------------------------------------


@query
def timeline_sorted(spark, sf_dir):
    placed = sl.numbered(log_ops(spark, sf_dir, "uuid"), ["entity_id"], tl.ORDER)
    return placed.select("entity_id", "pos", "ts_text", "seq", "payload")


@query
def timeline_group(spark, sf_dir):
    nested = tl.nested_timeline(all_ops(spark, sf_dir, "uuid"), ["seq", "source"], ["ts_text", "seq", "source"], block=50)
    items = F.transform("records", lambda r: F.concat(r["source"], F.lit(":"), r["seq"].cast("string")))
    return nested.select(
        "entity_id", "part", "block", F.size("records").cast("bigint").alias("n"), F.array_join(items, ",").alias("records")
    )


def _job_timeline(spark, sf_dir, build):
    ids = en.wanted_ids(supplier_ids(spark, sf_dir))
    ops = build(spark, sf_dir, "uuid", ids)
    return tl.timeline(ops).select("entity_id", "ts_text", "seq", "payload")


@query
def log_timeline(spark, sf_dir):
    return _job_timeline(spark, sf_dir, log_ops)


@query
def msg_timeline(spark, sf_dir):
    return _job_timeline(spark, sf_dir, msg_ops)


@query
def db_timeline(spark, sf_dir):
    return _job_timeline(spark, sf_dir, db_ops)


@query
def state_timestamps(spark, sf_dir):
    return vm_changes(spark, sf_dir, "uuid").select("entity_id", "ts_text")


@query
def history_left_join(spark, sf_dir):
    return tl.history_summary(vm_changes(spark, sf_dir, "vm", ("db",)), db_ops(spark, sf_dir, "vm"))


@query
def history_timeline(spark, sf_dir):
    return tl.history_timeline(vm_changes(spark, sf_dir), all_ops(spark, sf_dir), co.SOURCES)


# -- change histories --------------------------------------------------------


@query
def state_changes(spark, sf_dir):
    return vm_changes(spark, sf_dir, "uuid")


@query
def state_explode(spark, sf_dir):
    history = tl.nested_timeline(vm_changes(spark, sf_dir, "uuid"), ["ts_text", "state"])
    flat = history.select("entity_id", F.explode("records").alias("r"))
    return flat.select("entity_id", "r.ts_text", "r.state")


@query
def snapshot_expand(spark, sf_dir):
    return records_of(snapshot_lines(spark, sf_dir)).select(
        "host", "ts_text", "seq", "table", "record_id", F.size("cols").cast("bigint").alias("n_cols"),
        F.col("cols")["name"].alias("name_cell"), F.col("cols")["ports"].alias("ports_cell"),
    )


@query
def record_take(spark, sf_dir):
    records = sn.first_records(records_of(snapshot_lines(spark, sf_dir)))
    return records.select("ts_text", "seq", "table", "record_id")


@query
def tagged_decode(spark, sf_dir):
    records = sn.decode_cells(records_of(snapshot_lines(spark, sf_dir)))
    cell = F.col("cols")
    return records.select(
        "seq",
        "table",
        cell["_uuid"]["scalar"].alias("id"),
        cell["name"]["scalar"].alias("name"),
        cell["statistics"]["map"]["rx"].alias("rx"),
        cell["external_ids"]["map"]["iface-id"].alias("iface_id"),
        cell["external_ids"]["map"]["peers"].alias("peers"),
        F.coalesce(cell["external_ids"]["map"]["odd"], F.lit("none")).alias("odd"),
        cell["external_ids"]["map"]["deep"].alias("deep"),
        F.array_join(cell["ports"]["set"], ",").alias("ports"),
        F.concat_ws("|", cell["config"]["kind"], cell["config"]["map"]["mode"], cell["config"]["map"]["peers"]).alias("config"),
        cell["ports"]["kind"].alias("ports_kind"),
    )


@query
def record_changes(spark, sf_dir):
    records = records_of(snapshot_lines(spark, sf_dir)).withColumn("name_cell", F.col("cols")["name"])
    kept = sn.record_changes(records, only=["host", "name_cell"])
    return kept.select("record_id", "host", "table", "ts_text", "seq", "name_cell")


@query
def snapshot_changes(spark, sf_dir):
    kept = sn.snapshot_changes(sn.parse_snapshots(snapshot_lines(spark, sf_dir)), whole=False)
    return kept.select("host", "ts_text", "seq")


@query
def snapshot_history(spark, sf_dir):
    lines = snapshot_lines(spark, sf_dir)
    kept = sn.snapshot_changes(sn.parse_snapshots(lines), whole=False)
    return ch.found_again(lines, kept, ["seq"]).select("seq", "value")


@query
def snapshot_changes_prefix(spark, sf_dir):
    kept = pf.prefix_changes(sn.parse_snapshots(snapshot_lines(spark, sf_dir, "ports")))
    return kept.select("host", "ts_text", "seq")


@query
def iface_filter(spark, sf_dir):
    records = record_history(spark, sf_dir)
    return sn.with_iface(records, value=F.col("iface")).select("record_id", "table", "seq")


@query
def iface_rekey(spark, sf_dir):
    records = record_history(spark, sf_dir)
    return sn.rekey(records, new_key=F.col("iface")).select("entity_id", "record_id", "ts_text", "seq")


# -- look-back and correlation -----------------------------------------------

PAIR = ["entity_id", "ts_text", "seq", "state", "source", "op_ts_text", "op_seq"]


@query
def lookback_join(spark, sf_dir):
    return lb.lookback(vm_changes(spark, sf_dir, "rack"), all_ops(spark, sf_dir, "rack"), payload=False).select(*PAIR)


@query
def lookback_day(spark, sf_dir):
    return lb.lookback(vm_changes(spark, sf_dir), all_ops(spark, sf_dir), DAY, payload=False).select(*PAIR)


@query
def lookback_instant(spark, sf_dir):
    ops = db_ops(spark, sf_dir, "rack")
    return lb.lookback(vm_changes(spark, sf_dir, "rack", ("db",)), ops, compare="instant", payload=False).select(*PAIR)


@query
def lookback_log(spark, sf_dir):
    return lb.lookback(vm_changes(spark, sf_dir, "vm", ("log",)), log_ops(spark, sf_dir, "vm"), DAY).select(*PAIR, "payload")


@query
def lookback_msg(spark, sf_dir):
    return lb.lookback(vm_changes(spark, sf_dir, "vm", ("msg",)), msg_ops(spark, sf_dir, "vm"), DAY).select(*PAIR, "payload")


@query
def lookback_db(spark, sf_dir):
    return lb.lookback(vm_changes(spark, sf_dir, "vm", ("db",)), db_ops(spark, sf_dir, "vm"), DAY).select(*PAIR, "payload")


@query
def lookback_status(spark, sf_dir):
    found = lb.lookback_status(vm_changes(spark, sf_dir), all_ops(spark, sf_dir), co.SOURCES, DAY)
    return found.select("entity_id", "ts_text", "seq", "source", "status")


@query
def lookback_start(spark, sf_dir):
    states = vm_states(spark, sf_dir, "uuid")
    return states.select("seq", "ts_text", clock.lookback_start(F.col("ts_text"), 300).alias("start_text"))


def correlated(spark, sf_dir, entity, seconds=300):
    """From lines to correlation: histories, their ids, three matched timelines, each written once."""
    states = settle_rounds(vm_changes(spark, sf_dir, entity))
    ids = en.wanted_ids(states)
    ops = settle_rounds(co.union_ops([f(spark, sf_dir, entity, ids) for f in (log_ops, msg_ops, db_ops)]))
    return co.correlate(states, ops, seconds=seconds, written=True)


@query
def correlate(spark, sf_dir):
    return correlated(spark, sf_dir, "rack")


@query
def correlate_day(spark, sf_dir):
    return correlated(spark, sf_dir, "vm", DAY)


@query
def correlate_sorted(spark, sf_dir):
    ops = all_ops(spark, sf_dir, "rack")
    return co.sorted_by_key(co.correlate(vm_changes(spark, sf_dir, "rack"), ops, ordered=True)).drop("payload")


@query
def correlate_nested(spark, sf_dir):
    flat = co.correlate(vm_changes(spark, sf_dir), all_ops(spark, sf_dir), seconds=DAY)
    nested = co.nest(flat, state_fields=["state"])

    def seqs(source):
        ids = F.transform(F.col("ops")[source], lambda o: o["op_seq"].cast("string"))
        return F.array_join(ids, ",").alias(f"{source}_ops")

    return nested.select("entity_id", "ts_text", "seq", "part", "state", *[seqs(s) for s in co.SOURCES])


@query
def sample_hash(spark, sf_dir):
    states = vm_states(spark, sf_dir, "uuid").select("entity_id", "ts_text", "seq")
    return co.sample_by_key(states, ["entity_id", "ts_text"], 10)


@query
def tz_convert(spark, sf_dir):
    states = vm_states(spark, sf_dir, "uuid")
    moved = clock.shift_zone(F.col("ts_text"), "America/Los_Angeles", "UTC")
    return states.select("seq", "ts_text", moved.alias("utc_text"))
