"""What must not grow with the input: texts of plans, rows of a task."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statetrail.functions import jsontext, search, tagged
from statetrail.operators import correlate as co
from statetrail.operators import entities as en
from statetrail.operators import lineage
from statetrail.operators import lookback as lb
from statetrail.operators import prefix as pf
from statetrail.operators import slices as sl
from statetrail.operators import snapshots as sn
from statetrail.operators import timeline as tl
from statetrail.plans import event_lines as el


@pytest.fixture
def sf_dir(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=i), i % 5, ["view", "error", "click"][i % 3], 1.0, "{}") for i in range(100)]
    made = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bloom_filter_is_not_in_the_text_of_the_plan(spark, lines):
    ids = [f"0cc175b9-c0f1-46b6-831c-{i:012d}" for i in range(20)]
    wanted = en.wanted_ids(spark.createDataFrame([(i,) for i in ids[:10]], "entity_id string"), 0)
    found = en.match_lines(lines(*ids), wanted)
    assert len(plan(found)) < 100_000 and "BuildRight, LeftSemi, exists(" in plan(found)
    assert sorted(r["seq"] for r in found.collect()) == list(range(10))
    met = en.match_entities(lines(*ids), wanted.ids, broadcast=False)
    assert len(plan(met)) < 100_000 and met.count() == 10


def test_lines_are_dealt_to_tasks_of_bounded_length(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(el, "TASK_ROWS", 10, raising=False)
    made = el.event_lines(spark, sf_dir, "state")
    assert made.rdd.getNumPartitions() == 10 and made.count() == 100


def test_texts_that_are_no_json_are_told_without_parsing_them(spark):
    texts = ["1", " -2.5e3\n", "true", "null", '"a"', "[1]", ' {"a":1}', "click", "2024-01-01 00:00:00.000", "", "1,2", "1],[2", "truely", "NaN", "- 1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.col("t").rlike(jsontext.MAY_BE_JSON).alias("may"), F.to_json(jsontext.as_variant(F.col("t"))).alias("v")).collect()
    assert [json.loads(r["v"]) if r["v"] else None for r in rows] == [1, -2500, True, None, "a", [1], {"a": 1}] + [None] * 9
    assert not any(r["may"] for r in rows if r["t"] in ("click", "2024-01-01 00:00:00.000", "", "1,2"))


def test_cells_are_read_by_one_decoder_and_written_as_before():
    texts = ["a\"\\\n\t\x01\x7f é€", ""]
    assert [tagged._written([t]) for t in texts] == [json.dumps([t], ensure_ascii=False) for t in texts]
    made = []
    load = lambda t: made.append(t) or json.loads(t)
    assert tagged._decoded_cell('["set",["x"]]', load) == {"kind": "set", "set": ["x"]} and len(made) == 1


def test_the_range_of_a_row_is_looked_up_by_compiled_columns(spark):
    df = spark.createDataFrame([(i,) for i in (-1, 0, 1, 5, 9, 10, 11, None)], "v int")
    for items in ([], ["0"], ["0", "5"], ["0", "5", "10"], ["0", "0", "5", "10", "10"]):
        found = search.with_count_not_above(df, "n", items, T.IntegerType(), F.col("v")).collect()
        assert [r["n"] for r in found] == [sum(r["v"] is not None and int(i) <= r["v"] for i in items) for r in found]
    placed = sl.numbered(spark.range(100).selectExpr("id % 3 AS k", "id"), ["k"], ["id"])
    assert "lambdafunction" not in plan(placed) and {(r["k"], r["id"]): r["pos"] for r in placed.collect()} == {(i % 3, i): i // 3 + 1 for i in range(100)}


def test_a_timeline_of_histories_reads_its_input_once(spark):
    states = spark.range(30).selectExpr("concat('e', id % 4) AS entity_id", "concat('2024-01-01 00:00:', 10 + id) AS ts_text", "id AS seq", "concat('s', id) AS state")
    ops = spark.range(30).selectExpr("concat('e', id % 3) AS entity_id", "concat('2024-01-01 00:00:', 10 + id) AS ts_text", "id AS seq", "if(id % 2 = 0, 'log', 'msg') AS source")
    told = tl.history_timeline(states, ops, ["log", "msg"])
    assert "Range (" not in plan(told)
    rows = told.where("entity_id = 'e2'").orderBy("ts_text", "kind").collect()
    assert len(rows) == 17 and rows[-1]["n_log"] + rows[-1]["n_msg"] == 10 and rows[-1]["state"] == "s26"


def test_records_and_snapshots_are_parsed_once_for_their_histories(spark, lines):
    text = '{"timestamp":"2024-01-01 00:00:0%d","IP":"h","T":{"headings":["_uuid","name","statistics"],"data":[[["uuid","r"],"n%d",%d]]}}'
    made = lines(*[text % (i, i // 2, i) for i in range(6)])
    made = made.union(made.where("seq = 2"))  # a place that comes twice is found twice
    records = sn.expand_snapshots(sn.parse_snapshots(made)).withColumn("name", F.col("cols")["name"])
    kept = sn.record_changes(records, only=["host", "name"])
    assert "from_json" not in plan(kept) and "Scan ExistingRDD" in plan(kept)
    whole = sn.record_changes(records).select(*kept.columns)
    assert sorted(kept.collect()) == sorted(whole.collect()) and kept.count() == 4
    digests = sn.parse_snapshots(made).select(F.inline(sn.row_digests(F.col("tables"))))
    assert [r["row_pos"] for r in digests.collect()] == [0] * 7 and digests.distinct().count() == 3


def test_places_without_rows_are_counted_in_prefix_histories(spark, lines):
    text = '{"timestamp":"2024-01-01 00:00:0%d","IP":"h"%s}'
    table = ',"T":{"headings":["name"],"data":[["%s"]]}'
    made = lines(*[text % (i, table % c if c else "") for i, c in enumerate(["", "a", "", "a", "b"])])
    kept = pf.prefix_changes(sn.parse_snapshots(made))
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == [0]


def test_tasks_of_a_look_back_compare_a_bounded_number_of_pairs(spark, monkeypatch):
    at = "concat('2024-01-01 00:00:', lpad(id % 60, 2, '0')) AS ts_text"
    states = spark.range(90).selectExpr("if(id < 60, 'hot', concat('e', id % 7)) AS entity_id", at, "id % 50 AS seq", "concat('s', id) AS state")
    ops = spark.range(120).selectExpr("if(id < 80, 'hot', concat('e', id % 9)) AS entity_id", at, "id AS seq", "'log' AS source", "repeat('p', 9) AS payload")
    found = {}
    for most in (10**9, 500):
        monkeypatch.setattr(lb, "TASK_PAIRS", most, raising=False)
        pairs = lb.lookback(states, ops, 300)
        sizes = [len(p) for p in pairs.rdd.glom().collect()]
        found[most] = sorted(pairs.collect())
    assert found[500] == found[10**9] and len(found[500]) > 1_000
    assert len(sizes) >= 10 and max(sizes) < len(found[500]) / 2


def test_a_look_back_gives_an_operation_with_all_its_states(spark):
    states = spark.range(20).selectExpr("'e' AS entity_id", "concat('2024-01-01 00:00:', 30 + id) AS ts_text", "id AS seq")
    ops = spark.range(20).selectExpr("'e' AS entity_id", "'2024-01-01 00:00:10' AS ts_text", "id AS seq", "'log' AS source", "'p' AS payload")
    seqs = [r["op_seq"] for r in lb.lookback(states.hint("merge"), ops.hint("merge"), 300, written=True).collect()]
    assert len(seqs) == 400 and sum(a != b for a, b in zip(seqs, seqs[1:])) == 19


def test_pairs_without_payload_repeat_the_shorter_side(spark):
    states = spark.range(40).selectExpr("'e' AS entity_id", "concat('2024-01-01 00:00:', 20 + id) AS ts_text", "id AS seq")
    ops = spark.range(40).selectExpr("'e' AS entity_id", "'2024-01-01 00:00:10' AS ts_text", "id AS seq", "'log' AS source", "'p' AS payload")
    for n_states, n_ops, outer in ((40, 10, "seq"), (10, 40, "op_seq")):
        some = [states.filter(f"seq < {n_states}").hint("merge"), ops.filter(f"seq < {n_ops}").hint("merge")]
        pairs = lb.lookback(*some, 300, written=True, payload=False)
        seqs = [r[outer] for r in pairs.collect()]
        assert len(seqs) == 400 and sum(a != b for a, b in zip(seqs, seqs[1:])) == 39 and "payload" not in pairs.columns
        whole = lb.lookback(*some, 300, written=True)
        assert sorted(whole.drop("payload").collect()) == sorted(pairs.collect()) and whole.columns[-1] == "payload"


def test_an_interface_id_is_read_from_the_cell_as_it_was_parsed(spark, lines):
    cells = ['["map",[["iface-id","if-1"],["n",1]]]', '["map",[["iface-id","a"],["iface-id","b"]]]', '["map",[["iface-id",%s]]]' % "1.50e1", '["map",[["iface-id",0.10]]]',
             '["map",[["iface-id",["uuid","u"]]]]', '["map",[["iface-id",["set",["x"]]]]]', '["map",[["iface-id",null],["k"]]]', '["set",[]]', '"if-1"', "null", '{"iface-id":"x"}', "[]", "7"]
    headed = lambda h, row: '{"timestamp":"2024-01-01 00:00:00","IP":"h","T":{"headings":[%s],"data":[[["uuid","r"]%s]]}}' % (h, row)
    texts = [headed('"_uuid","external_ids"', "," + c) for c in cells]
    twice = '"_uuid","external_ids","external_ids"'
    texts += [headed(twice, f",{cells[0]},{cells[1]}"), headed(twice, f",{cells[0]}"), headed(twice, ""), headed('"_uuid"', f",{cells[0]}")]
    records = sn.expand_snapshots(sn.parse_snapshots(lines(*texts)), iface=True)
    rows = records.select("iface", sn.iface_id(F.col("cols")).alias("read")).collect()
    assert len(rows) == len(texts) and all(r["iface"] == r["read"] for r in rows), rows
    assert [r["iface"] for r in rows[:2]] == ["if-1", "b"] and rows[13]["iface"] == "b" and rows[14]["iface"] == "if-1"


def test_pairs_are_made_where_they_are_sorted(spark, monkeypatch):
    at = "if(id % 30 = 7, null, concat('2024-01-01 00:0', id % 4, ':', lpad(id % 60, 2, '0'))) AS ts_text"
    # some states come twice, some have no time, some no operations
    states = spark.range(200).selectExpr("if(id < 60, 'hot', concat('e', id % 7)) AS entity_id", at, "id % 50 AS seq", "concat('s', id % 100) AS state")
    states = states.unionByName(states.limit(70))
    ops = spark.range(240).selectExpr("if(id < 80, 'hot', concat('e', id % 5)) AS entity_id", at, "id AS seq", "if(id % 3 = 0, 'log', 'msg') AS source", "'p' AS payload")
    order = ["entity_id", "ts_text", "seq", "source", "op_ts_text", "op_seq"]
    monkeypatch.setattr(lb, "SORTED_PAIRS", 800)
    found = co.sorted_by_key(co.correlate(states, ops, ordered=True))
    plain = co.sorted_by_key(co.correlate(states, ops))
    assert found.columns == plain.columns
    assert "rangepartitioning" in plan(plain) and "rangepartitioning" not in plan(found)
    # the pairs of a task are sorted by one number
    assert next(x for x in plan(found).split("\n") if " Sort [" in x).count(" ASC") == 1
    rows = found.collect()
    assert [tuple(r[c] for c in order) for r in rows] == [tuple(r[c] for c in order) for r in plain.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, plain.collect())) and len(rows) > 5_000
    sizes = [len(p) for p in found.rdd.glom().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2_000
    # one state with more operations than a task should have is sorted by all columns
    monkeypatch.setattr(lb, "SORTED_PAIRS", 5)
    cut = co.sorted_by_key(co.correlate(states, ops, ordered=True))
    assert "rangepartitioning" in plan(cut) and sorted(map(str, cut.collect())) == sorted(map(str, rows))
    assert co.sorted_by_key(co.correlate(states.limit(0), ops, ordered=True)).count() == 0


def test_prefix_histories_follow_ranges_and_broadcast_no_table(spark, tmp_path, monkeypatch):
    text = '{"timestamp":"2024-01-01 00:00:00","IP":"h%d","T":{"headings":["name"],"data":[%s]}}'
    cells = [[f"n{i % 7}", f"m{i // 11}", f"k{i % 2}"][: 1 + i % 3] for i in range(400)]
    made = [(i, text % (i % 2, ",".join(f'["{c}"]' for c in row))) for i, row in enumerate(cells)]
    # lines that come twice are at two places, and both are found by their name
    spark.createDataFrame(made + made[50:60], "seq bigint, value string").write.parquet(f"{tmp_path}/lines")
    want, before = [], {}
    for i, row in enumerate(cells):
        if i % 2 not in before or any(a != b for a, b in zip(before[i % 2], row)):
            before[i % 2] = row
            want.append(i)
    plans, sizes = [], []

    def told(df):
        plans.append(plan(df))
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return lineage.settle_rounds(df)

    for at in (pf, sl):
        monkeypatch.setattr(at, "settle_rounds", told)
    kept = pf.prefix_changes(sn.parse_snapshots(spark.read.parquet(f"{tmp_path}/lines")), parts=4)
    assert sorted(r["seq"] for r in kept.collect()) == sorted(want + [w for w in want if 50 <= w < 60]) and len(want) > 100
    # an estimate is squared each round; rounds go with the ranges, not with the places
    assert max(sizes) < 10**1_000 and len(plans) < 20
    assert not any("BroadcastHashJoin [seq" in p for p in plans)
