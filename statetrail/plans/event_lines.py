"""Input lines of every format, derived row by row from the ``events`` table.

The same templates give the text in Spark and in DuckDB, so a query that parses
Spark's lines can be checked against SQL over the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "S": "string",
    "ts_ms": "concat(substr(cast(ts as string),1,19),'.',rpad(substr(cast(ts as string),21,3),3,'0'))",
    "ts_sec": "substr(cast(ts as string),1,19)",
    "week": "substr(cast(date_trunc('week', ts) as string),1,10)",
    "bs": "\\\\",
}
DUCKDB = {
    "S": "varchar",
    "ts_ms": "strftime(ts,'%Y-%m-%d %H:%M:%S.%g')",
    "ts_sec": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
    "week": "strftime(date_trunc('week', ts),'%Y-%m-%d')",
    "bs": "\\",
}

_SHAPE = "substr({h},1,8)||'-'||substr({h},9,4)||'-4'||substr({h},14,3)||'-8'||substr({h},18,3)||'-'||substr({h},21,12)"

BASE = [
    ("es", "cast(event_id as {S})"),
    ("us", "cast(user_id as {S})"),
    ("ts_ms", "{ts_ms}"),
    ("ts_sec", "{ts_sec}"),
    # an entity per user, one per user and week, one per neighbouring user, and one that seven
    # of eight users share for a week
    ("uuid", _SHAPE.replace("{h}", "md5(cast(user_id as {S}))")),
    ("vm", _SHAPE.replace("{h}", "md5(cast(user_id as {S})||'/'||{week})")),
    ("rack", _SHAPE.replace("{h}", "md5(CASE WHEN user_id%8=0 THEN cast(user_id as {S}) ELSE 'all' END||'/rack/'||{week})")),
    ("link", "CASE WHEN event_type='error' THEN 'down' ELSE 'up' END"),
    ("wk", "{week}"),
    ("peer", _SHAPE.replace("{h}", "md5(cast(user_id+1 as {S}))")),
]

_HEAD = "ts_ms||' do_'||event_type||' /srv/app.py:'||es||' '||us||' '"
_REQ = "' [req-'||es||' u'||us||' t1] '"

LINES = {
    # formats in turn; the last two name another format's marker and must be dropped
    "log": "CASE WHEN event_id%11=0 THEN 'junk '||{id} "
    f"WHEN event_id%5=0 THEN {_HEAD}||'INFO svc.'||event_type||' [-] [instance: '||{{id}}||'] done' "
    f"WHEN event_id%5=1 THEN {_HEAD}||'INFO svc.'||event_type||{_REQ}||'[instance: '||{{id}}||'] done' "
    f"WHEN event_id%5=2 THEN {_HEAD}||'TRACE svc.'||event_type||' Traceback '||{{id}} "
    f"WHEN event_id%5=3 THEN {_HEAD}||'INFO svc.'||event_type||{_REQ}||{{id}}||' state [-] moved' "
    f"ELSE {_HEAD}||'INFO svc.'||event_type||{_REQ}||{{id}}||' TRACE on' END",
    # some contents begin with quoted text, which the greedy fields take in
    "db": "es||',\"'||ts_sec||'\",\"'||event_type||'\",\"instances\",'||"
    "CASE WHEN event_id%4=0 THEN '\"'||{id}||'\",\"b\",c' ELSE '{{\"uuid\": \"'||{id}||'\"}}' END",
    # JSON inside a string value, comma at the end
    "msg": "'{{\"timestamp\": \"'||ts_ms||'\", \"event\": \"'||event_type||'\", \"body\": \"{{{bs}\"id{bs}\": {bs}\"'||{id}||"
    "'{bs}\", {bs}\"n{bs}\": {bs}\"'||es||'{bs}\"}}\"}},'",
    "state": "'{{\"uuid\": \"'||{id}||'\", \"timestamp\": \"'||ts_ms||'\", \"status\": \"'||event_type||"
    "'\", \"vcpu\": '||cast(user_id%4 as {S})||'}},'",
    # eight hosts, statistics differ every time
    "snapshot": "'{{\"timestamp\": \"'||ts_ms||'\", \"IP\": \"10.1.0.'||cast(user_id%8 as {S})||"
    "'\", \"Interface\": {{\"headings\": [\"_uuid\",\"name\",\"statistics\",\"external_ids\"], \"data\": [[[\"uuid\",\"'||{id}||'\"],\"'||event_type||"
    "'\",[\"map\",[[\"rx\",'||es||']]],[\"map\",['||CASE WHEN user_id%7=0 OR event_type='error' THEN '' ELSE '[\"iface-id\",\"if-'||us||'\"],' END||"
    "'[\"peers\",[\"set\",[\"a\",[\"uuid\",\"'||us||'\"],[\"zz\",1]]]],[\"odd\",[\"zz\",1]],"
    "[\"deep\",[\"map\",[[\"b\",[\"set\",[[\"map\",[[\"c\",[\"set\",[[\"map\",[[\"d\",[\"uuid\",\"'||us||'\"]],"
    "[\"o\",{{\"z\":[\"set\",[\"'||us||'\"]],\"a\":1}}]]],null]]]]],true]]]]]]]]]]}}, "
    "\"Bridge\": {{\"headings\": [\"_uuid\",\"ports\",\"config\"], \"data\": [[[\"uuid\",\"br-'||cast(user_id%8 as {S})||"
    "'\"],[\"set\",[[\"uuid\",\"p1\"],[\"uuid\",\"p2\"]]],{{\"mode\":\"m\",\"peers\":[\"set\",[\"p1\"]]}}]]}}}},'",
    # one table of one to three rows, so that comparing the rows both have is not transitive
    "ports": "'{{\"timestamp\": \"'||ts_ms||'\", \"IP\": \"10.1.0.'||cast(user_id%8 as {S})||"
    "'\", \"Port\": {{\"headings\": [\"name\",\"statistics\"], \"data\": [[\"'||link||'\",'||es||']'||"
    "CASE WHEN event_id%3>0 THEN ',[\"'||event_type||'\",'||es||']' ELSE '' END||"
    "CASE WHEN event_id%3>1 THEN ',[\"'||wk||'\",'||es||']' ELSE '' END||']}}}},'",
    # several ids: two dashed, one repeated, one undashed inside other text, one in capitals
    "mention": "'ev '||{id}||' and '||peer||' again '||{id}||' raw'||replace({id},'-','')||'ff '||upper(peer)",
}


#: Events whose lines one task makes and parses, about.
TASK_ROWS = 250_000


def _fill(template: str, dialect: dict, entity: str = "uuid") -> str:
    return template.format(id=entity, **dialect)


def event_lines(spark: SparkSession, sf_dir: str, kind: str, entity: str = "uuid") -> DataFrame:
    """Lines of one kind with the event's id as ``seq`` and its type as ``role``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # lines are far larger than their rows, so a split of the table would be hours of parsing:
    # it is dealt to all cores and to tasks of bounded length, however large it is
    wanted = max(spark.sparkContext.defaultParallelism, -(-events.count() // TASK_ROWS))
    if events.rdd.getNumPartitions() < wanted:
        events = events.repartition(wanted, "event_id")
    base = events.selectExpr("*", *[f"{_fill(x, SPARK)} AS {name}" for name, x in BASE])
    line = _fill(LINES[kind], SPARK, entity)
    return base.selectExpr(f"{line} AS value", "event_id AS seq", "event_type AS role")


def oracle_base() -> str:
    """CTE ``e``: events with the derived columns, for DuckDB."""
    columns = ", ".join(f"{_fill(x, DUCKDB)} AS {name}" for name, x in BASE)
    return f"e AS (SELECT *, {columns} FROM events)"


def oracle_line(kind: str, entity: str = "uuid") -> str:
    """Expression over ``e`` giving the line text, for DuckDB."""
    return _fill(LINES[kind], DUCKDB, entity)
