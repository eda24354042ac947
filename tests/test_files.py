import json
import random

import pytest
from pyspark.sql import functions as F

from statetrail.operators.changes import changes
from statetrail.operators.parse import parse_states
from statetrail.plans import jobs
from statetrail.sinks import write_ids, write_json_lines, write_table
from statetrail.sources import number_lines, read_entities, read_lines, read_table

VM = "0cc175b9-c0f1-46b6-831c-399e26977266"
PORT = "92eb5ffe-e6ae-4fec-8ad7-1c777531578f"


def put(path, *texts):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(t + "\n" for t in texts))
    return str(path)


def test_lines_in_file_order_with_provenance(spark, tmp_path):
    for split in (0, 1):
        put(tmp_path / "in" / f"split_{split:02d}" / "part-0", *[f'{{"n": {i}}},' for i in range(50)])
    put(tmp_path / "in" / "split_00" / "_SUCCESS", "marker")
    df = read_lines(spark, str(tmp_path / "in"), strip=",\n", depth=1, label=("split", r"(split_\d+)"))
    rows = df.orderBy("seq").collect()
    assert [r["value"] for r in rows] == [f'{{"n": {i}}}' for i in range(50)] * 2
    assert [r["split"] for r in rows] == ["split_00"] * 50 + ["split_01"] * 50
    assert rows[0]["src"].endswith("part-0")


def test_line_order_holds_over_blocks(spark, tmp_path):
    put(tmp_path / "big", *[f"{i:06d} {'x' * 50}" for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = read_lines(spark, str(tmp_path / "big"))
        assert df.rdd.getNumPartitions() > 3
        got = [r["value"][:6] for r in df.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i:06d}" for i in range(2000)]


def test_line_numbers_are_those_of_the_files(spark, tmp_path):
    rnd = random.Random(8)
    texts = {f"f{n}": [f"{n} {i} {'x' * rnd.randrange(80)}" for i in range(rnd.choice([1, 40, 900]))] for n in range(7)}
    for name, part in texts.items():
        put(tmp_path / "in" / name, *part)
    put(tmp_path / "in" / "empty")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines, files = number_lines(read_lines(spark, str(tmp_path / "in")))
        assert lines.columns == ["value", "seq"]
        names = {r["file"]: r["path"].rsplit("/", 1)[1] for r in files.collect()}
        got = sorted((names[r["seq"]["file"]], r["seq"]["line"], r["value"]) for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((name, i + 1, t) for name, part in texts.items() for i, t in enumerate(part))


def test_globs_partitions_and_entities(spark, tmp_path):
    put(tmp_path / "host1" / "svc" / "a.log", "one")
    put(tmp_path / "host2" / "svc" / "b.log", "two")
    assert read_lines(spark, str(tmp_path), depth=2).count() == 2
    assert read_lines(spark, str(tmp_path / "*" / "svc" / "a*")).count() == 1
    assert read_lines(spark, [str(tmp_path / "host1" / "svc"), str(tmp_path / "host2" / "svc")], partitions=5).rdd.getNumPartitions() == 5
    ids = read_entities(spark, put(tmp_path / "ids", VM, VM, VM + " "))
    assert sorted(r[0] for r in ids.collect()) == [VM, VM + " "]


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "entity_id string, x int")
    for write, name in ((write_table, "t"), (write_json_lines, "j"), (write_ids, "i")):
        write(df, str(tmp_path / name))
        with pytest.raises(Exception, match="already exists"):
            write(df, str(tmp_path / name))
    assert read_table(spark, str(tmp_path / "t")).collect() == df.collect()
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"entity_id": "a", "x": None}]
    assert read_entities(spark, str(tmp_path / "i")).collect()[0][0] == "a"
    write_table(df.withColumn("host", F.lit("h")), str(tmp_path / "p"), partition_by=["host"])
    assert (tmp_path / "p" / "host=h").is_dir()


def ts(second):
    return f"2015-06-16 10:{second // 60:02d}:{second % 60:02d}"


@pytest.fixture
def inputs(tmp_path):
    head = " do /srv/app.py:1 7 INFO svc [r u t] "
    put(tmp_path / "logs" / "a", ts(10) + ".000" + head + VM, ts(20) + ".000" + head + PORT, "junk " + VM, "nobody asked")
    put(tmp_path / "msgs" / "split_00", json.dumps({"timestamp": ts(11) + ".500", "body": json.dumps({"id": VM, "n": "5"})}) + ",")
    put(tmp_path / "msgs" / "split_01", json.dumps({"timestamp": ts(12) + ".500", "body": PORT}) + ",")
    put(tmp_path / "db" / "a", f'1,"{ts(13)}","update","instances",{VM}', "not asked, not parsed")
    state = lambda s, status: json.dumps({"uuid": VM, "timestamp": ts(s) + ".000", "status": status}) + ","
    put(tmp_path / "vm" / "a", state(15, "run"), state(16, "run"), state(700, "stop"))

    def snapshot(s, name):
        cells = [["uuid", "rec-1"], name, ["map", [["rx", s]]], ["map", [["iface-id", PORT]]]]
        table = {"headings": ["_uuid", "name", "statistics", "external_ids"], "data": [cells]}
        return json.dumps({"timestamp": ts(s) + ".000", "IP": "10.1.0.2", "Interface": table}) + ","

    put(tmp_path / "switch" / "10.1.0.2.out", snapshot(25, "tap0"), snapshot(26, "tap0"), snapshot(27, "tap1"))
    return tmp_path


def run_path(spark, root, states):
    """From states to a correlation, through every hand-off on disk."""
    p = lambda name: str(root / name)
    jobs.entity_ids(spark, states, p("ids"))
    jobs.log_timeline(spark, p("logs"), p("log_out"), p("ids"))
    jobs.message_timeline(spark, p("msgs/*"), p("msg_out"), p("ids"))
    jobs.db_timeline(spark, p("db"), p("db_out"), p("ids"))
    jobs.correlate(spark, p("log_out"), p("msg_out"), p("db_out"), states, p("out"))
    rows = read_table(spark, p("out")).collect()
    return sorted((r["entity_id"], r["ts_text"], r["source"], r["status"], r["op_ts_text"] or "") for r in rows)


def test_vm_path(spark, inputs):
    jobs.vm_history(spark, str(inputs / "vm"), str(inputs / "vm_out"))
    assert run_path(spark, inputs, str(inputs / "vm_out")) == [
        (VM, ts(15) + ".000", "db", "matched", ts(13)),
        (VM, ts(15) + ".000", "log", "matched", ts(10) + ".000"),
        (VM, ts(15) + ".000", "msg", "matched", ts(11) + ".500"),
        (VM, ts(700) + ".000", "db", "none_in_window", ""),
        (VM, ts(700) + ".000", "log", "none_in_window", ""),
        (VM, ts(700) + ".000", "msg", "none_in_window", ""),
    ]


@pytest.mark.parametrize("mode", ["strict", "prefix"])
def test_switch_path(spark, inputs, mode):
    p = lambda name: str(inputs / name)
    jobs.snapshot_history(spark, p("switch"), p("snap_out"), mode)
    assert read_table(spark, p("snap_out")).count() == 2
    jobs.record_history(spark, p("snap_out"), p("rec_out"))
    jobs.iface_history(spark, p("rec_out"), p("iface_out"))
    assert run_path(spark, inputs, p("iface_out")) == [
        (PORT, ts(s) + ".000", *rest)
        for s in (25, 27)
        for rest in (
            ("db", "no_ops", ""),
            ("log", "matched", ts(20) + ".000"),
            ("msg", "matched", ts(12) + ".500"),
        )
    ]


def test_vm_history_as_json_lines(spark, inputs):
    jobs.vm_history(spark, str(inputs / "vm"), str(inputs / "json_out"), as_json=True)
    rows = [json.loads(r[0]) for r in spark.read.text(str(inputs / "json_out")).collect()]
    assert sorted(json.loads(r["state"])["status"] for r in rows) == ["run", "stop"]


def test_only_new_splits_are_read(spark, tmp_path):
    head = " do /srv/app.py:1 7 INFO svc [r u t] "
    line = lambda s: ts(s) + ".000" + head + VM
    put(tmp_path / "logs" / "h1" / "s0" / "a", line(1), line(2), "junk " + VM)
    put(tmp_path / "logs" / "h2" / "s0" / "a", line(3))
    ids, glob, store = put(tmp_path / "ids", VM), str(tmp_path / "logs/*/*/*"), str(tmp_path / "store")
    add = lambda: jobs.timeline_add(spark, "log", glob, store, ids)
    rows = lambda: sorted((r["host"], r["split"], r["ts_text"][-6:-4]) for r in read_table(spark, store + "/rows").collect())
    assert add() == 2 and rows() == [("h1", "s0", "01"), ("h1", "s0", "02"), ("h2", "s0", "03")]
    written = {p for p in (tmp_path / "store" / "rows").rglob("*.parquet")}
    assert add() == 0 and {p for p in (tmp_path / "store" / "rows").rglob("*.parquet")} == written
    put(tmp_path / "logs" / "h1" / "s1" / "a", line(4))
    put(tmp_path / "logs" / "h2" / "s0" / "b", line(5))
    assert add() == 2 and rows()[2:] == [("h1", "s1", "04"), ("h2", "s0", "03"), ("h2", "s0", "05")]
    assert {p for p in written if "host=h1" in str(p)} <= {p for p in (tmp_path / "store" / "rows").rglob("*.parquet")}


def test_vm_history_continues(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda i, s: json.dumps({"uuid": VM, "timestamp": ts(i) + ".000", "s": s}) + ","
    states, store = {}, str(tmp_path / "store")
    # the second and third splits have later states and late ones
    for n, seconds in enumerate((range(0, 40, 2), [*range(40, 60), 5, 7, 9], [33, 61])):
        split = {i: rnd.choice("xy") for i in seconds}
        states |= split
        put(tmp_path / "vm" / f"split_{n}", *[text(i, s) for i, s in split.items()])
        assert jobs.vm_history_add(spark, str(tmp_path / "vm"), store) == 1
        order = sorted(states)
        want = [ts(i) + ".000" for j, i in enumerate(order) if j == 0 or states[order[j - 1]] != states[i]]
        got = jobs.stored_history(spark, store)
        assert sorted(r["ts_text"] for r in got.collect()) == want and got.agg(F.sum("n")).first()[0] == len(states)
    assert jobs.vm_history_add(spark, str(tmp_path / "vm"), store) == 0


def test_bad_lines_by_policy(spark, inputs):
    p = lambda name: str(inputs / name)
    put(inputs / "ids", VM, PORT)
    jobs.log_timeline(spark, p("logs"), p("out"), p("ids"), bad_lines="quarantine")
    assert read_table(spark, p("out/parse_ok=true")).count() == 2
    assert [(r["entity_id"], r["bad_line"]) for r in read_table(spark, p("out/parse_ok=false")).collect()] == [(VM, "junk " + VM)]
    with pytest.raises(Exception, match="does not parse"):
        jobs.log_timeline(spark, p("logs"), p("out2"), p("ids"), bad_lines="fail")


def test_usage():
    assert jobs.options_of(jobs.log_timeline, ["--bad-lines=drop"]) == {"bad_lines": "drop"}
    assert jobs.options_of(jobs.vm_history, ["--json"]) == {"as_json": True}
    assert jobs.options_of(jobs.vm_history, ["--bad-lines=drop"]) is None and jobs.options_of(jobs.log_timeline, ["--bad-lines=x"]) is None
    assert jobs.main(["log-timeline", "a", "b", "c", "--no-such"]) == 1
    assert jobs.main([]) == 1
    assert jobs.main(["correlate", "too", "few"]) == 1
    assert jobs.main(["no-such-job"]) == 1


def test_interleaved_files_do_not_break_histories(spark, tmp_path):
    """States of one VM spread over files in no order."""
    rnd = random.Random(3)
    states = [(i, rnd.choice("xyz")) for i in range(60)]
    shuffled = states[:]
    rnd.shuffle(shuffled)
    for f in range(3):
        put(
            tmp_path / "vm" / f"f{f}",
            *[json.dumps({"uuid": VM, "timestamp": ts(i) + ".000", "s": s}) for i, s in shuffled[f::3]],
        )
    jobs.vm_history(spark, str(tmp_path / "vm"), str(tmp_path / "out"))
    want = [ts(i) + ".000" for i, s in states if i == 0 or states[i - 1][1] != s]
    assert sorted(r["ts_text"] for r in read_table(spark, str(tmp_path / "out")).collect()) == want


def test_cut_groups_over_files(spark, tmp_path):
    """Equal times are ordered by place in the file, in ranges of any size."""
    rnd = random.Random(4)
    states = [(i // 4, rnd.choice("xy")) for i in range(400)]
    put(tmp_path / "vm" / "f", *[json.dumps({"uuid": VM, "timestamp": ts(i), "s": s}) + "," for i, s in states])
    given = read_lines(spark, str(tmp_path / "vm"), strip=",\n")
    kept = changes(parse_states(given), "entity_id", ["ts_text", "seq"], ["state"], 9)
    got = sorted(r["seq"]["row"] for r in kept.select("seq").collect())
    want = [i for i, (_, s) in enumerate(states) if i == 0 or states[i - 1][1] != s]
    assert len(got) == len(want) and [g - got[0] for g in got] == want
