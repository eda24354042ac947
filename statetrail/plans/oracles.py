"""DuckDB SQL for the registered queries, over the same tables and lines."""

from __future__ import annotations

from statetrail.functions.patterns import (
    DB_FIELDS,
    DB_RECORD,
    DB_RECORD_STRICT,
    LOG_CONTEXT,
    LOG_DEFAULT,
    LOG_FIELDS,
    LOG_TRACE,
    UUID_V4,
)
from statetrail.plans.event_lines import oracle_base, oracle_line

DAY = 86_400
E = oracle_base()

_IDS = (
    "ids AS (SELECT DISTINCT substr(h,1,8)||'-'||substr(h,9,4)||'-4'||substr(h,14,3)||'-8'||substr(h,18,3)||'-'||"
    "substr(h,21,12) AS entity_id FROM (SELECT md5(CAST(s_suppkey AS VARCHAR)) AS h FROM supplier))"
)
_MENTION = oracle_line("mention")


def _mentions(normalize: bool = False) -> str:
    text = "lower(value)" if normalize else "value"
    ident = "replace(u, '-', '')" if normalize else "u"
    return (
        f"lines AS (SELECT event_id AS seq, {_MENTION} AS value FROM e), "
        f"m AS (SELECT DISTINCT seq, value, {ident} AS entity_id FROM "
        f"(SELECT seq, value, unnest(regexp_extract_all({text}, '{UUID_V4}')) AS u FROM lines))"
    )


def _group(pattern: str, i: int, text: str = "value") -> str:
    if i > 9:  # DuckDB numbers groups up to 9 only
        pattern, i = pattern.replace("(", "(?:", 1), i - 1
    return f"regexp_extract({text}, '{pattern}', {i})"


def _log_select(fields: dict[str, str], pattern: str) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in fields.items())


def _log_fields(pattern: str, fmt: str) -> dict[str, str]:
    g = lambda i: _group(pattern, i)
    head = {"timestamp": g(1), "funcName": g(2), "pathNameLineno": g(3), "process": g(4)}
    if fmt == "default":
        rest = {"levelName": g(5), "name": g(6), "content": g(7)}
    elif fmt == "trace":
        rest = {"levelName": "'TRACE'", "name": g(5), "content": g(6)}
    else:
        rest = {"levelName": g(5), "name": g(6), "content": g(10)}
        return head | rest | {"requestID": g(7), "user": g(8), "tenant": g(9)}
    null = "CAST(NULL AS VARCHAR)"
    return head | rest | {"requestID": null, "user": null, "tenant": null}


_LOG_PATTERNS = {"default": LOG_DEFAULT, "trace": LOG_TRACE, "context": LOG_CONTEXT}


def _log_table(entity: str = "uuid", where: str = "true") -> str:
    """CTEs for parsed log lines: ``lp`` with format NULL for dropped lines."""
    branches = []
    for fmt, pattern in _LOG_PATTERNS.items():
        branches.append(
            f"SELECT seq, id, value, '{fmt}' AS format, {_log_select(_log_fields(pattern, fmt), pattern)} FROM routed "
            f"WHERE route = '{fmt}' AND regexp_matches(value, '{pattern}')"
        )
    nulls = ", ".join(f'CAST(NULL AS VARCHAR) AS "{f}"' for f in LOG_FIELDS)
    bad = " OR ".join(f"(route = '{f}' AND NOT regexp_matches(value, '{p}'))" for f, p in _LOG_PATTERNS.items())
    branches.append(f"SELECT seq, id, value, CAST(NULL AS VARCHAR) AS format, {nulls} FROM routed WHERE {bad}")
    return (
        f"raw_log AS (SELECT event_id AS seq, {entity} AS id, {oracle_line('log', entity)} AS value FROM e WHERE {where}), "
        "routed AS (SELECT *, CASE WHEN contains(value,'[-]') THEN 'default' WHEN contains(value,'TRACE') THEN 'trace' "
        "ELSE 'context' END AS route FROM raw_log), "
        "lp AS (" + " UNION ALL ".join(branches) + ")"
    )


_ROLES = {"log": "click", "msg": "purchase", "db": "signup"}
_ALL = tuple(_ROLES)


def _role(entity: str, kind: str, sources: tuple[str, ...] = _ALL) -> str:
    """Events that stand for a kind of line: all, or one part where states meet operations."""
    if entity == "uuid":
        return "true"
    if kind == "state":
        return "event_type NOT IN (" + ", ".join(f"'{_ROLES[s]}'" for s in sources) + ")"
    return f"event_type = '{_ROLES[kind]}'"


def _changes(entity: str, sources: tuple[str, ...] = _ALL) -> str:
    """CTE ``s``: change history of the state lines of an entity."""
    return (
        f"s AS (SELECT entity_id, ts_text, seq, state FROM (SELECT {entity} AS entity_id, ts_ms AS ts_text, event_id AS seq, "
        f"event_type AS state, user_id%4 AS vcpu, lag(event_type) OVER w AS p, lag(user_id%4) OVER w AS pv FROM e WHERE {_role(entity, 'state', sources)} "
        f"WINDOW w AS (PARTITION BY {entity} ORDER BY ts_ms, event_id)) "
        "WHERE p IS NULL OR p IS DISTINCT FROM state OR pv IS DISTINCT FROM vcpu)"
    )


def _json(fields: list[str]) -> str:
    return "CAST(json_object(" + ", ".join(f"'{f}', \"{f}\"" for f in fields) + ") AS VARCHAR)"


def _ops(entity: str, sources: tuple[str, ...] = ("log", "msg", "db"), ids: str = "") -> str:
    """CTEs ending in ``ops``; ``ids`` is a filter on the entity column."""
    keep = f"WHERE id IN ({ids})" if ids else ""
    parts = {
        "log": f"SELECT id AS entity_id, 'log' AS source, \"timestamp\" AS ts_text, seq, {_json(LOG_FIELDS)} AS payload "
        f"FROM (SELECT * FROM lp WHERE format IS NOT NULL) {keep}",
        "msg": f"SELECT id AS entity_id, 'msg' AS source, ts_ms AS ts_text, event_id AS seq, "
        "'{\"body\":{\"id\":\"'||id||'\",\"n\":'||es||'},\"event\":\"'||event_type||'\",\"timestamp\":\"'||ts_ms||'\"}' AS payload "
        f"FROM (SELECT *, {entity} AS id FROM e WHERE {_role(entity, 'msg')}) {keep}",
        "db": f"SELECT eid AS entity_id, 'db' AS source, \"timestamp\" AS ts_text, seq, {_json(DB_FIELDS)} AS payload "
        f"FROM dbp {keep.replace('WHERE id', 'WHERE eid')}",
    }
    db = ", ".join(f"{_group(DB_RECORD, i + 1)} AS \"{f}\"" for i, f in enumerate(DB_FIELDS))
    ctes = []
    if "log" in sources:
        ctes.append(_log_table(entity, _role(entity, "log")))
    if "db" in sources:
        ctes.append(
            f"dbp AS (SELECT seq, eid, {db} FROM (SELECT event_id AS seq, {entity} AS eid, "
            f"{oracle_line('db', entity)} AS value FROM e WHERE {_role(entity, 'db')}))"
        )
    ctes.append("ops AS (" + " UNION ALL ".join(parts[s] for s in sources) + ")")
    return ", ".join(ctes)


def _start(seconds: int, ts: str = "ts_text") -> str:
    return f"strftime(CAST({ts} AS TIMESTAMP) - INTERVAL {seconds} SECOND, '%Y-%m-%d %H:%M:%S.%g')"


def _pairs(seconds: int, sources: tuple[str, ...] = _ALL, instant: bool = False, entity: str = "vm") -> str:
    """CTEs ending in ``pairs``: state x operation inside the window."""
    inside = (
        f"CAST(o.ts_text AS TIMESTAMP) BETWEEN CAST(s.ts_text AS TIMESTAMP) - INTERVAL {seconds} SECOND AND CAST(s.ts_text AS TIMESTAMP)"
        if instant
        else f"o.ts_text BETWEEN {_start(seconds, 's.ts_text')} AND s.ts_text"
    )
    return (
        f"{E}, {_changes(entity, sources)}, {_ops(entity, sources)}, "
        "pairs AS (SELECT s.entity_id, s.ts_text, s.seq, s.state, o.source, o.ts_text AS op_ts_text, o.seq AS op_seq, o.payload "
        f"FROM s JOIN ops o ON s.entity_id = o.entity_id AND {inside})"
    )


def _status() -> str:
    return (
        "src AS (SELECT unnest(['log','msg','db']) AS source), "
        "st AS (SELECT s.*, src.source, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.entity_id=s.entity_id AND "
        "p.ts_text=s.ts_text AND p.seq=s.seq AND p.source=src.source) THEN 'matched' WHEN EXISTS (SELECT 1 FROM ops o WHERE "
        "o.entity_id=s.entity_id AND o.source=src.source) THEN 'none_in_window' ELSE 'no_ops' END AS status FROM s, src)"
    )


def _correlated(seconds: int, entity: str) -> str:
    return (
        f"WITH {_pairs(seconds, entity=entity)}, {_status()}, "
        "flat AS (SELECT entity_id, ts_text, seq, state, source, op_ts_text, op_seq, payload, 'matched' AS status FROM pairs "
        "UNION ALL SELECT entity_id, ts_text, seq, state, source, NULL, NULL, NULL, status FROM st WHERE status <> 'matched')"
    )


_PAIR = "entity_id, ts_text, seq, state, source, op_ts_text, op_seq"
_DBL = ", ".join(f"{_group(DB_RECORD, i + 1)} AS \"{f}\"" for i, f in enumerate(DB_FIELDS))
_DBS = ", ".join(f"{_group(DB_RECORD_STRICT, i + 1)} AS \"{f}\"" for i, f in enumerate(DB_FIELDS))
_DB_LINES = f"lines AS (SELECT event_id AS seq, {oracle_line('db')} AS value FROM e)"
_LOGF = ", ".join(f'"{f}"' for f in LOG_FIELDS)
_HOST = "'10.1.0.'||CAST(user_id%8 AS VARCHAR)"
_BRIDGE = "'br-'||CAST(user_id%8 AS VARCHAR)"
_IFACE_CELL = "'[\"uuid\",\"'||uuid||'\"]'"
_PORTS_CELL = "'[\"set\",[[\"uuid\",\"p1\"],[\"uuid\",\"p2\"]]]'"
_RECORDS = (
    f"r AS (SELECT {_HOST} AS host, ts_ms AS ts_text, event_id AS seq, 'Interface' AS \"table\", uuid AS record_id, "
    "CAST(4 AS BIGINT) AS n_cols, '\"'||event_type||'\"' AS name_cell, CAST(NULL AS VARCHAR) AS ports_cell, us, es, event_type, user_id FROM e "
    f"UNION ALL SELECT {_HOST}, ts_ms, event_id, 'Bridge', {_BRIDGE}, 3, NULL, {_PORTS_CELL}, us, es, event_type, user_id FROM e)"
)
_REC_CHANGES = (
    "rc AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lag(name_cell) OVER w AS p FROM r "
    "WINDOW w AS (PARTITION BY record_id ORDER BY ts_text, seq)) WHERE rn = 1 OR p IS DISTINCT FROM name_cell)"
)


_HAS_IFACE = "(\"table\"='Interface' AND user_id%7<>0 AND event_type<>'error')"


def _timeline(source: str) -> str:
    return (
        f"WITH {E}, {_IDS}, {_ops('uuid', (source,), 'SELECT entity_id FROM ids')} "
        "SELECT entity_id, ts_text, seq, payload FROM ops"
    )


def _lookback_source(source: str) -> str:
    return f"WITH {_pairs(DAY, (source,))} SELECT {_PAIR}, payload FROM pairs"


def _stretch(ts: str) -> str:
    """Number of the hour a time is in."""
    return f"CAST(floor(epoch(CAST({ts} AS TIMESTAMP)) / 3600) AS BIGINT)"


def _list(source: str) -> str:
    return (
        f"coalesce((SELECT string_agg(CAST(p.op_seq AS VARCHAR), ',' ORDER BY p.op_ts_text, p.op_seq) FROM pp p WHERE "
        f"p.entity_id=s.entity_id AND p.ts_text=s.ts_text AND p.seq=s.seq AND p.part=s.part AND p.source='{source}'), "
        f"CASE WHEN EXISTS (SELECT 1 FROM ops o WHERE o.entity_id=s.entity_id AND o.source='{source}') THEN '' END) AS {source}_ops"
    )


ORACLES: dict[str, str] = {
    "uuid_extract": f"WITH {E} SELECT event_id AS seq, array_to_string(list_filter(x, lambda u, i: list_position(x, u) = i), '|') AS ids "
    f"FROM (SELECT event_id, regexp_extract_all({_MENTION}, '{UUID_V4}') AS x FROM e)",
    "uuid_explode": f"WITH {E}, {_mentions()} SELECT seq, entity_id FROM m",
    "uuid_match": f"WITH {E}, {_IDS}, {_mentions()} SELECT seq, entity_id, value FROM m JOIN ids USING (entity_id)",
    "uuid_match_shuffled": f"WITH {E}, {_IDS}, {_mentions()} SELECT seq, entity_id, value FROM m JOIN ids USING (entity_id)",
    **{
        name: f"WITH {E}, {_IDS}, lines AS (SELECT event_id AS seq, {_MENTION} AS value FROM e), "
        f"x AS (SELECT seq, unnest(regexp_extract_all(value, '{UUID_V4}')) AS u, generate_subscripts(regexp_extract_all(value, '{UUID_V4}'), 1) AS i FROM lines), "
        "y AS (SELECT seq, u, min(i) AS i FROM x WHERE u IN (SELECT entity_id FROM ids) GROUP BY seq, u) "
        "SELECT seq, string_agg(u, '|' ORDER BY i) AS ids, value FROM y JOIN lines USING (seq) GROUP BY seq, value"
        for name in ("uuid_lines", "uuid_lines_shuffled")
    },
    "uuid_match_normalized": f"WITH {E}, {_IDS}, {_mentions(True)} SELECT seq, m.entity_id FROM m JOIN "
    "(SELECT DISTINCT replace(entity_id, '-', '') AS entity_id FROM ids) i ON i.entity_id = m.entity_id",
    "uuid_filter": f"WITH {E}, {_IDS}, {_mentions()} SELECT DISTINCT seq, value FROM m WHERE entity_id IN (SELECT entity_id FROM ids)",
    "entity_ids": f"WITH {E} SELECT DISTINCT uuid AS entity_id FROM e",
    "db_parse": f"WITH {E}, {_DB_LINES} SELECT seq, {_DBL} FROM lines",
    "db_parse_strict": f"WITH {E}, {_DB_LINES} SELECT seq, {_DBS} FROM lines",
    "log_parse": f"WITH {E}, {_log_table()} SELECT seq, format, {_LOGF} FROM lp",
    "log_wellformed": f"WITH {E}, {_log_table()} SELECT seq, format, value FROM lp WHERE format IS NOT NULL",
    "log_parse_any": f"WITH {E}, lines AS (SELECT event_id AS seq, {oracle_line('log')} AS value FROM e) "
    f"SELECT seq, 'default' AS format, {_group(LOG_DEFAULT, 7)} AS content, NULL AS \"requestID\" FROM lines WHERE regexp_matches(value, '{LOG_DEFAULT}') "
    f"UNION ALL SELECT seq, 'trace', {_group(LOG_TRACE, 6)}, NULL FROM lines WHERE NOT regexp_matches(value, '{LOG_DEFAULT}') AND regexp_matches(value, '{LOG_TRACE}') "
    f"UNION ALL SELECT seq, 'context', {_group(LOG_CONTEXT, 10)}, {_group(LOG_CONTEXT, 7)} FROM lines WHERE NOT regexp_matches(value, '{LOG_DEFAULT}') "
    f"AND NOT regexp_matches(value, '{LOG_TRACE}') AND regexp_matches(value, '{LOG_CONTEXT}')",
    "msg_decode": f"WITH {E} SELECT event_id AS seq, ts_ms AS ts_text, event_type AS event, uuid AS body_id, event_id AS body_n, 'BIGINT' AS n_type, "
    "'{\"body\":{\"id\":\"'||uuid||'\",\"n\":'||es||'},\"event\":\"'||event_type||'\",\"timestamp\":\"'||ts_ms||'\"}' AS body FROM e",
    "msg_decode_paths": f"WITH {E} SELECT event_id AS seq, ts_ms AS ts_text, event_type AS event, uuid AS body_id, es AS body_n FROM e",
    "state_parse": f"WITH {E} SELECT uuid AS entity_id, ts_ms AS ts_text, event_id AS seq, event_type AS status_text, user_id%4 AS vcpu FROM e",
    "timeline_sorted": f"WITH {E}, {_ops('uuid', ('log',))} SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts_text, seq) AS pos, "
    "ts_text, seq, payload FROM ops",
    "timeline_group": f"WITH {E}, {_ops('uuid')}, x AS (SELECT *, substr(ts_text, 1, 10) AS part, "
    "(row_number() OVER (PARTITION BY entity_id ORDER BY ts_text, seq, source) - 1) // 50 AS block FROM ops) "
    "SELECT entity_id, part, block, count(*) AS n, "
    "string_agg(source||':'||CAST(seq AS VARCHAR), ',' ORDER BY ts_text, seq, source) AS records FROM x GROUP BY entity_id, part, block",
    "log_timeline": _timeline("log"),
    "msg_timeline": _timeline("msg"),
    "db_timeline": _timeline("db"),
    "state_timestamps": f"WITH {E}, {_changes('uuid')} SELECT entity_id, ts_text FROM s",
    "history_timeline": f"WITH {E}, {_changes('vm')}, {_ops('vm')}, "
    "ev AS (SELECT entity_id, ts_text, seq, 'state' AS kind, state FROM s UNION ALL SELECT entity_id, ts_text, seq, source, NULL FROM ops), "
    "x AS (SELECT entity_id, ts_text, seq, kind, last_value(state IGNORE NULLS) OVER w AS state, "
    "last_value(CASE WHEN kind='state' THEN ts_text END IGNORE NULLS) OVER w AS since, "
    "count(*) FILTER (kind='log') OVER w AS n_log, count(*) FILTER (kind='msg') OVER w AS n_msg, count(*) FILTER (kind='db') OVER w AS n_db FROM ev "
    "WINDOW w AS (PARTITION BY entity_id ORDER BY ts_text, CASE WHEN kind='state' THEN 1 ELSE 0 END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT entity_id, ts_text, seq, kind, state, since, "
    + ", ".join(f"CASE WHEN entity_id IN (SELECT entity_id FROM ops) THEN n_{k} END AS n_{k}" for k in ("log", "msg", "db"))
    + " FROM x WHERE entity_id IN (SELECT entity_id FROM s)",
    "history_left_join": f"WITH {E}, {_changes('vm', ('db',))}, {_ops('vm', ('db',))}, "
    "a AS (SELECT entity_id, count(*) AS n_states, min(ts_text) AS first_state, max(ts_text) AS last_state FROM s GROUP BY 1), "
    "b AS (SELECT entity_id, count(*) AS n_ops, min(ts_text) AS first_op, max(ts_text) AS last_op FROM ops GROUP BY 1) "
    "SELECT * FROM a LEFT JOIN b USING (entity_id)",
    "state_changes": f"WITH {E}, {_changes('uuid')} SELECT entity_id, ts_text, seq, state FROM s",
    "state_explode": f"WITH {E}, {_changes('uuid')} SELECT entity_id, ts_text, state FROM s",
    "snapshot_expand": f"WITH {E}, {_RECORDS} SELECT host, ts_text, seq, \"table\", record_id, n_cols, name_cell, ports_cell FROM r",
    "record_take": f"WITH {E}, {_RECORDS} SELECT ts_text, seq, \"table\", record_id FROM r ORDER BY ts_text, seq, \"table\" LIMIT 10",
    "tagged_decode": f"WITH {E}, {_RECORDS} SELECT seq, \"table\", record_id AS id, "
    "CASE WHEN \"table\"='Interface' THEN event_type END AS name, CASE WHEN \"table\"='Interface' THEN es END AS rx, "
    f"CASE WHEN {_HAS_IFACE} THEN 'if-'||us END AS iface_id, "
    "CASE WHEN \"table\"='Interface' THEN '[\"a\",\"'||us||'\",null]' END AS peers, 'none' AS odd, "
    "CASE WHEN \"table\"='Interface' THEN '{\"b\":[{\"c\":[{\"d\":\"'||us||'\",\"o\":{\"a\":1,\"z\":[\"'||us||'\"]}},null]},true]}' END AS deep, "
    " CASE WHEN \"table\"='Bridge' THEN 'p1,p2' END AS ports, "
    " CASE WHEN \"table\"='Bridge' THEN 'object|m|[\"p1\"]' ELSE '' END AS config, "
    "CASE WHEN \"table\"='Bridge' THEN 'set' END AS ports_kind FROM r",
    "record_changes": f"WITH {E}, {_RECORDS}, {_REC_CHANGES} SELECT record_id, host, \"table\", ts_text, seq, name_cell FROM rc",
    "snapshot_changes": f"WITH {E} SELECT host, ts_text, seq FROM (SELECT {_HOST} AS host, ts_ms AS ts_text, event_id AS seq, "
    "row_number() OVER w AS rn, uuid||event_type||us AS fp, lag(uuid||event_type||us) OVER w AS p FROM e "
    f"WINDOW w AS (PARTITION BY {_HOST} ORDER BY ts_ms, event_id)) WHERE rn = 1 OR p <> fp",
    "snapshot_changes_prefix": f"WITH RECURSIVE {E}, n AS MATERIALIZED (SELECT {_HOST} AS host, ts_ms AS ts_text, event_id AS seq, event_id%3 AS more, link, event_type, wk, "
    f"row_number() OVER (PARTITION BY {_HOST} ORDER BY ts_ms, event_id) AS pos FROM e), "
    "nxt AS MATERIALIZED (SELECT a.host, a.pos, min(b.pos) AS next FROM n a JOIN n b ON a.host = b.host AND b.pos > a.pos AND (a.link <> b.link "
    "OR (a.more > 0 AND b.more > 0 AND a.event_type <> b.event_type) OR (a.more > 1 AND b.more > 1 AND a.wk <> b.wk)) GROUP BY a.host, a.pos), "
    "kept AS (SELECT host, pos FROM n WHERE pos = 1 UNION ALL SELECT k.host, x.next FROM kept k JOIN nxt x ON x.host = k.host AND x.pos = k.pos) "
    "SELECT host, ts_text, seq FROM n JOIN kept USING (host, pos)",
    "snapshot_history": f"WITH {E} SELECT seq, rtrim({oracle_line('snapshot')}, ',') AS value FROM (SELECT *, event_id AS seq, "
    "row_number() OVER w AS rn, uuid||event_type||us AS fp, lag(uuid||event_type||us) OVER w AS p FROM e "
    f"WINDOW w AS (PARTITION BY {_HOST} ORDER BY ts_ms, event_id)) WHERE rn = 1 OR p <> fp",
    "iface_filter": f"WITH {E}, {_RECORDS}, {_REC_CHANGES} SELECT record_id, \"table\", seq FROM rc "
    f"WHERE record_id IN (SELECT record_id FROM rc WHERE {_HAS_IFACE})",
    "iface_rekey": f"WITH {E}, {_RECORDS}, {_REC_CHANGES} SELECT 'if-'||us AS entity_id, record_id, ts_text, seq FROM rc "
    f"WHERE record_id IN (SELECT record_id FROM rc WHERE {_HAS_IFACE})",
    "lookback_join": f"WITH {_pairs(300, entity='rack')} SELECT {_PAIR} FROM pairs",
    "lookback_day": f"WITH {_pairs(DAY)} SELECT {_PAIR} FROM pairs",
    "lookback_instant": f"WITH {_pairs(300, ('db',), True, 'rack')} SELECT {_PAIR} FROM pairs",
    "lookback_log": _lookback_source("log"),
    "lookback_msg": _lookback_source("msg"),
    "lookback_db": _lookback_source("db"),
    "lookback_status": f"WITH {_pairs(DAY)}, {_status()} SELECT entity_id, ts_text, seq, source, status FROM st",
    "lookback_start": f"WITH {E} SELECT event_id AS seq, ts_ms AS ts_text, {_start(300, 'ts_ms')} AS start_text FROM e",
    "correlate": _correlated(300, "rack") + " SELECT * FROM flat",
    "correlate_day": _correlated(DAY, "vm") + " SELECT * FROM flat",
    "correlate_sorted": _correlated(300, "rack") + " SELECT * EXCLUDE (payload) FROM flat ORDER BY entity_id, ts_text, seq, source, op_ts_text, op_seq",
    "correlate_nested": f"WITH {_pairs(DAY)}, pp AS (SELECT *, {_stretch('ts_text')} - {_stretch('op_ts_text')} AS part FROM pairs), "
    "sp AS (SELECT DISTINCT s.*, coalesce(pp.part, 0) AS part FROM s LEFT JOIN pp USING (entity_id, ts_text, seq)) "
    f"SELECT entity_id, ts_text, seq, part, state, {_list('log')}, {_list('msg')}, {_list('db')} FROM sp s",
    "sample_hash": f"WITH {E} SELECT uuid AS entity_id, ts_ms AS ts_text, event_id AS seq FROM e "
    "WHERE CAST('0x'||substr(md5(uuid||'|'||ts_ms),1,8) AS BIGINT) % 1000 < 10",
    "tz_convert": f"WITH {E} SELECT event_id AS seq, ts_ms AS ts_text, "
    "strftime(timezone('UTC', timezone('America/Los_Angeles', CAST(ts_ms AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S.%g') AS utc_text FROM e",
}
for _fmt in _LOG_PATTERNS:
    ORACLES[f"log_parse_{_fmt}"] = f"WITH {E}, {_log_table()} SELECT seq, {_LOGF} FROM lp WHERE format = '{_fmt}'"
