import json

import pytest
from pyspark.sql import functions as F

from statetrail.functions.jsontext import as_variant
from statetrail.operators.entities import extract_entities, match_entities
from statetrail.operators.parse import as_ops, decode_messages, parse_db, parse_log, parse_states

HEAD = "2015-06-16 10:00:00.123 do_it /srv/app.py:12 77 "
U = "0cc175b9-c0f1-46b6-831c-399e26977266"


def by_seq(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_log_formats_and_routing(lines):
    df = lines(
        HEAD + "INFO svc [-] hello",
        HEAD + "INFO svc [req-1 u1 t1] hello",
        HEAD + "TRACE svc Traceback (most recent call last)",
        HEAD + "TRACE svc [-] level word kept by the default format",
        HEAD + "INFO svc [req-1 u1 t1] moved to [-]",
        HEAD + "INFO svc [req-1 u1 t1] TRACE on",
        "junk",
    )
    kept = by_seq(parse_log(df), "format", "levelName", "content", "requestID", "user", "tenant")
    assert kept == {
        0: ("default", "INFO", "hello", None, None, None),
        1: ("context", "INFO", "hello", "req-1", "u1", "t1"),
        2: ("trace", "TRACE", "Traceback (most recent call last)", None, None, None),
        3: ("default", "TRACE", "level word kept by the default format", None, None, None),
    }
    flagged = by_seq(parse_log(df, on_bad_record="quarantine"), "parse_ok", "format", "timestamp", "value")
    assert [flagged[i][0] for i in range(7)] == [True] * 4 + [False] * 3
    assert flagged[6] == (False, None, None, "junk")
    tried = by_seq(parse_log(df, routing="any"), "format", "content")
    assert tried[4] == ("context", "moved to [-]")
    assert tried[5] == ("context", "TRACE on")
    assert 6 not in tried


def test_log_fields_in_place(lines):
    row = parse_log(lines(HEAD + "INFO svc.x [r u t] msg")).first()
    assert [row[c] for c in ("timestamp", "funcName", "pathNameLineno", "process", "name", "ts_text")] == [
        "2015-06-16 10:00:00.123", "do_it", "/srv/app.py:12", "77", "svc.x", "2015-06-16 10:00:00.123",
    ]


def test_content_runs_over_unicode_line_ends_and_dollars(lines):
    text = "a b\u0085c \\ $1 \\1"
    assert parse_log(lines(HEAD + "INFO svc [-] " + text)).first()["content"] == text
    assert parse_db(lines('1,"2015-06-16 10:00:00","e","t",' + text)).first()["content"] == text


def test_db_fields_are_greedy_unless_strict(lines):
    df = lines('7,"2015-06-16 10:00:00","update","instances","a","b",c', '8,"2015-06-16 10:00:01","e","t",')
    fields = ("id", "event", "tablename", "content")
    assert by_seq(parse_db(df), *fields) == {0: ("7", 'update","instances","a', "b", "c"), 1: ("8", "e", "t", "")}
    assert by_seq(parse_db(df, strict_fields=True), *fields)[0] == ("7", "update", "instances", '"a","b",c')


def test_bad_records(spark, lines):
    df = lines('1,"2015-06-16 10:00:00","e","t",' + U, "no record about " + U, "no record, no id")
    ids = spark.createDataFrame([(U,)], "entity_id string")
    matched = match_entities(df, ids)
    assert parse_db(matched, on_bad_record="drop").count() == 1
    assert sorted(r["parse_ok"] for r in parse_db(matched, on_bad_record="quarantine").collect()) == [False, True]
    with pytest.raises(Exception, match="does not parse: no record about"):
        parse_db(matched).select("seq").collect()
    # the bad line nobody asked for does no harm
    good = match_entities(df.filter("seq <> 1"), ids)
    assert parse_db(good).count() == 1
    with pytest.raises(ValueError):
        parse_db(matched, on_bad_record="ignore")


def body_of(lines, text):
    row = decode_messages(lines(text)).first()
    return json.loads(row["body"]), row["ts_text"]


def test_nested_json_messages(lines):
    inner = json.dumps({"b": "12", "c": json.dumps(["true", "null", {"d": "x"}])})
    body, ts = body_of(lines, json.dumps({"timestamp": "2015-06-16 10:00:00.1", "a": inner, "n": "NaN", "t": " 7 "}))
    assert body == {
        "timestamp": "2015-06-16 10:00:00.1",
        "a": {"b": 12, "c": [True, None, {"d": "x"}]},
        "n": "NaN",
        "t": 7,
    }
    assert ts == "2015-06-16 10:00:00.1"


def test_message_text_that_only_looks_like_json(lines):
    odd = {"timestamp": "x", "a": "12 monkeys", "b": "[1", "c": "-", "d": "01", "e": "", "f": "nullx", "g": "1e999", "h": '"q"'}
    body, _ = body_of(lines, json.dumps(odd))
    assert body == {**odd, "h": "q"}


def test_message_repeated_key_keeps_the_last(lines):
    assert body_of(lines, '{"timestamp": "t", "a": 1, "a": "2"}')[0] == {"timestamp": "t", "a": 2}


def test_messages_must_be_objects_with_a_timestamp(lines):
    df = lines('{"timestamp": "t"}', '{"x": 1}', "[1]", "text", '"{\\"timestamp\\": \\"s\\"}"', None)
    assert by_seq(decode_messages(df, on_bad_record="quarantine"), "parse_ok", "ts_text") == {
        0: (True, "t"), 1: (False, None), 2: (False, None), 3: (False, None), 4: (True, "s"), 5: (False, None),
    }
    with pytest.raises(Exception, match="does not parse"):
        decode_messages(df).collect()


def test_messages_nested_too_deep_are_bad_lines(lines):
    deep = lambda n: '{"timestamp": "t", "a": ' + "[" * n + "]" * n + "}"
    df = lines(deep(50), deep(1500), deep(20000), '{"timestamp": 5}')
    got = by_seq(decode_messages(df, on_bad_record="quarantine"), "parse_ok", "ts_text")
    assert got[0] == (True, "t") and got[2] == (False, None) and got[3] == (True, "5")
    assert got[1] in {(True, "t"), (False, None)}


def test_known_paths_decode_natively(lines):
    df = lines('{"timestamp": "t", "body": "{\\"id\\": 5}", "other": "12 monkeys", "plain": {"k": 1}}')
    row = decode_messages(df, paths=["body", "other", "plain"]).select(
        F.col("body.body").cast("string"), F.col("body.other").cast("string"), F.col("body.plain").cast("string")
    ).first()
    assert list(row) == ['{"id":5}', "12 monkeys", '{"k":1}']


def test_variant_only_of_whole_texts(spark):
    texts = ['{"a":1}', '{"a":1} x', "1,2", "[1]] ", '{"a":1}}', "12", "12]", "", '{"a":1},"y":2']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(as_variant(F.col("t")).cast("string")).collect()]
    assert got == ['{"a":1}', None, None, None, None, "12", None, None, None]


def test_states(lines):
    df = lines(
        '{"uuid": "u", "timestamp": "t", "b": {"y": 1, "x": [1, "1"]}, "a": "q"}',
        '{"a": "q", "b": {"x": [1, "1"], "y": 1}, "timestamp": "t2", "uuid": "u"}',
        '{"uuid": "u", "timestamp": "t", "b": {"y": "1", "x": [1, "1"]}, "a": "q"}',
    )
    assert parse_states(lines(' {"uuid": "u", "timestamp": "t"}\t ')).count() == 1
    states = by_seq(parse_states(df), "entity_id", "ts_text", "state")
    assert states[0][:2] == ("u", "t") and states[1][1] == "t2"
    assert states[0][2] == states[1][2]
    assert states[0][2] != states[2][2]


@pytest.mark.parametrize(
    "bad",
    ['{"uuid": "u"}', '{"uuid": "u", "timestamp": "t"} {"x": 1}', '{"uuid": "u", "timestamp": "t"', "[]",
     '{"uuid": null, "timestamp": "t"}', '{"uuid": "u", "uuid": "v", "timestamp": "t"}'],
)
def test_bad_states_fail(lines, bad):
    assert parse_states(lines(bad), on_bad_record="drop").count() == 0
    with pytest.raises(Exception, match="does not parse"):
        parse_states(lines(bad)).collect()


def test_ops_payload_keeps_nulls(lines):
    parsed = parse_db(extract_entities(lines('1,"2015-06-16 10:00:00","e","t",' + U)))
    row = as_ops(parsed.withColumn("event", F.lit(None).cast("string")), "db", ["id", "event"]).first()
    assert row.asDict() == {
        "entity_id": U, "source": "db", "ts_text": "2015-06-16 10:00:00", "seq": 0, "payload": '{"id":"1","event":null}',
    }
