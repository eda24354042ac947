import json
import random

import pytest
from pyspark.sql import functions as F

from statetrail.functions.tagged import decode_tagged, map_entry
from statetrail.operators.prefix import prefix_changes
from statetrail.operators.snapshots import (
    decode_cells,
    expand_snapshots,
    parse_snapshots,
    record_changes,
    rekey,
    snapshot_changes,
)


def snap(i, host="h", **tables):
    body = {n: {"headings": h, "data": d} for n, (h, d) in tables.items()}
    return json.dumps({"timestamp": f"2015-06-16 00:00:{i:02d}.000", "IP": host, **body})


def rows_of(i, *values, host="h"):
    return snap(i, host, T=(["name"], [[v] for v in values]))


@pytest.mark.parametrize(
    "cell, want",
    [
        ('["map",[["a","b"]]]', ("map", None, None, {"a": "b"}, None)),
        ('["map",[["a",["uuid","u"]],["n",5]]]', ("map", None, None, {"a": "u", "n": "5"}, None)),
        ('["map",[["a","x"],["a","y"]]]', ("map", None, None, {"a": "y"}, None)),
        ('["map",[]]', ("map", None, None, {}, None)),
        ('["set",[]]', ("set", None, [], None, None)),
        ('["set",[["uuid","p"],"q",3]]', ("set", None, ["p", "q", "3"], None, None)),
        ('["uuid","u"]', ("uuid", "u", None, None, None)),
        ('["zz",1]', ("unknown", None, None, None, '["zz",1]')),
        ("[1,2,3]", ("unknown", None, None, None, "[1,2,3]")),
        ('"text"', ("scalar", "text", None, None, None)),
        ("true", ("scalar", "true", None, None, None)),
        ("null", ("scalar", None, None, None, None)),
    ],
)
def test_tagged_values(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    got = df.select(decode_tagged(F.col("c")).alias("d")).select("d.*").first()
    assert tuple(got) == want


@pytest.mark.parametrize(
    "cell, want",
    [
        ('["map",[["k",["set",["a","b"]]]]]', {"k": '["a","b"]'}),
        ('["map",[["k",["map",[["y",["uuid","u"]],["x",1]]]]]]', {"k": '{"x":1,"y":"u"}'}),
        ('["map",[["k",["zz",1]],["l",[1,2,3]]]]', {"k": None, "l": None}),
        ('["map",[["k",["set",[["set",["a",["zz",1]]],true,null]]]]]', {"k": '[["a",null],true,null]'}),
        ('["map",[["k",["set",["a",["set",["b",["set",["c",["set",["d"]]]]]]]]]]]', {"k": '["a",["b",["c",["d"]]]]'}),
        ('["map",[["k",{"b":["map",[["y",{"z":["uuid","u"]}],["x",1.5]]],"a":[1]}]]]', {"k": '{"a":null,"b":{"x":1.5,"y":{"z":"u"}}}'}),
        ('["map",[[null,1],["k",["set",[]]],["k",2],["l",["map",[]]]]]', {"k": "2", "l": "{}"}),
    ],
)
def test_tagged_values_inside(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(decode_tagged(F.col("c"))["map"]).first()[0] == want
    listed = df.select(F.concat(F.lit('["set",['), "c", F.lit("]]")).alias("c"))
    assert len(listed.select(decode_tagged(F.col("c"))["set"]).first()[0]) == 1


def test_objects_and_any_depth(spark):
    deep, plain = '"x"', '"x"'
    for i in range(200):
        deep, plain = f'["set",[{deep},["map",[["k{i}",{i}]]]]]', f'[{plain},{{"k{i}":{i}}}]'
    cells = {"o": '{"a":["uuid","u"],"b":{"c":["set",[1]]}}', "d": deep, "s": '"text"', "w": None, "bad": "{"}
    df = spark.createDataFrame([(cells,), ({},), (None,)], "cols map<string,string>").coalesce(1)
    got = [r["cols"] for r in decode_cells(df).collect()]
    assert tuple(got[0]["o"]) == ("object", None, None, {"a": "u", "b": '{"c":[1]}'}, None)
    assert got[0]["d"]["set"] == [json.dumps(json.loads(plain)[0], separators=(",", ":")), '{"k199":199}']
    assert got[0]["s"]["scalar"] == "text" and got[0]["w"]["kind"] == "unknown" and got[0]["bad"]["raw"] == "{" and got[1:] == [{}, None]


def test_records_without_an_id(lines):
    df = lines(snap(1, T=(["name"], [["a"], ["b"]])), record(2, "r1", name="x"))
    records = expand_snapshots(parse_snapshots(df))
    with pytest.raises(Exception, match="without _uuid"):
        record_changes(records).collect()
    for policy in ("drop", "quarantine"):
        assert [r["record_id"] for r in record_changes(records, on_bad_record=policy).collect()] == ["r1"]


def test_map_entry(spark):
    df = spark.createDataFrame([('["map",[["k","v"]]]',), ('["map",[]]',), ('"x"',), (None,)], "c string")
    assert [r[0] for r in df.select(map_entry(F.col("c"), "k")).collect()] == ["v", None, None, None]


def test_expand(lines):
    text = snap(
        1,
        A=(["_uuid", "name"], [[["uuid", "r1"], "x"], [["uuid", "r2"], "y"]]),
        B=(["_uuid", "n", "n", "gone"], [[["uuid", "r3"], 1, 2]]),
        C=(["_uuid"], []),
    )
    got = {r["record_id"]: r for r in expand_snapshots(parse_snapshots(lines(text))).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r2"]["cols"] == {"_uuid": '["uuid","r2"]', "name": '"y"'}
    assert (got["r2"]["table"], got["r2"]["row_pos"], got["r2"]["host"]) == ("A", 1, "h")
    # repeated heading: the last wins; the shorter row ends the pairing
    assert got["r3"]["cols"] == {"_uuid": '["uuid","r3"]', "n": "2"}


def record(i, uid, host="h", **cells):
    return snap(i, host, T=(["_uuid", *cells], [[["uuid", uid], *cells.values()]]))


def test_record_changes_ignore_statistics(lines):
    df = lines(
        record(1, "r", name="a", statistics=1),
        record(2, "r", name="a", statistics=2),
        record(3, "r", name="b", statistics=2),
        record(4, "r", statistics=2, name="b"),
        record(5, "r", name="b", statistics=2, extra=1),
    )
    kept = record_changes(expand_snapshots(parse_snapshots(df)))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 4]


def test_record_key_can_include_the_host(lines):
    df = lines(record(1, "r", "h1", name="a"), record(2, "r", "h2", name="b"), record(3, "r", "h1", name="a"))
    records = expand_snapshots(parse_snapshots(df))
    assert record_changes(records).count() == 3
    assert record_changes(records, key=["host", "record_id"]).count() == 2


def test_strict_snapshot_changes(lines):
    df = lines(
        snap(1, T=(["name", "statistics"], [["a", 1]])),
        snap(2, T=(["name", "statistics"], [["a", 2]])),
        snap(3, T=(["name", "statistics"], [["a", 2], ["b", 2]])),
        snap(4, "other", T=(["name", "statistics"], [["a", 1]])),
        snap(5, T=(["name", "statistics"], [["a", 2], ["b", 2]]), U=(["name"], [])),
    )
    assert sorted(r["seq"] for r in snapshot_changes(parse_snapshots(df)).collect()) == [0, 2, 3, 4]


def kept_by_prefix(df, **options):
    return sorted(r["seq"] for r in prefix_changes(parse_snapshots(df), **options).collect())


def test_prefix_keeps_on_common_rows_only(lines):
    df = lines(rows_of(1, 1), rows_of(2, 1, 2), rows_of(3, 1, 3), rows_of(4, 2), rows_of(5, 2, 9))
    assert kept_by_prefix(df) == [0, 3]
    assert sorted(r["seq"] for r in snapshot_changes(parse_snapshots(df)).collect()) == [0, 1, 2, 3, 4]
    assert kept_by_prefix(lines(rows_of(1), rows_of(2, 7))) == [0]


@pytest.mark.parametrize("parts", [None, 11])
def test_prefix_against_walking_the_snapshots(lines, parts):
    rnd = random.Random(11)
    snaps = [
        (rnd.choice(["h1", "h1", "h2"]), {t: [rnd.randrange(3) for _ in range(rnd.randrange(3))] for t in "AB"})
        for _ in range(60)
    ]
    df = lines(*[snap(i, h, **{t: (["name"], [[v] for v in vs]) for t, vs in tables.items()}) for i, (h, tables) in enumerate(snaps)])
    want = []
    for host in ("h1", "h2"):
        ref = None
        for i, (h, tables) in enumerate(snaps):
            if h != host:
                continue
            if ref is None or any(a != b for t in ref for a, b in zip(ref[t], tables[t])):
                want.append(i)
                ref = tables
    assert kept_by_prefix(df, parts=parts) == sorted(want)


def test_rekey_takes_the_first_known_interface(lines):
    iface = lambda x: ["map", [["iface-id", x]]]
    df = lines(
        record(1, "r1", external_ids=["map", []]),
        record(2, "r1", external_ids=iface("if-1")),
        record(3, "r1", external_ids=iface("if-2")),
        record(4, "r2", external_ids=["map", [["other", "x"]]]),
        record(5, "r3", name="no such column"),
    )
    records = expand_snapshots(parse_snapshots(df))
    assert sorted((r["entity_id"], r["seq"]) for r in rekey(records).collect()) == [("if-1", 0), ("if-1", 1), ("if-1", 2)]
    decoded = decode_cells(records)
    typed = F.try_element_at(F.col("cols")["external_ids"]["map"], F.lit("iface-id"))
    assert rekey(decoded, new_key=typed).count() == 3
