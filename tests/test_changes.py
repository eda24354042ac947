import random

import pytest
from pyspark.sql import functions as F

from statetrail.operators import slices
from statetrail.operators.changes import changes
from statetrail.operators.timeline import history_summary, history_timeline, nested_timeline, timeline


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts_text string, seq bigint, v string")


def random_rows(seed, n=400):
    """One key with most of the rows, many equal timestamps, values with NULL."""
    rnd = random.Random(seed)
    return [
        (rnd.choice(["hot", "hot", "hot", "a", "b"]), f"t{rnd.randrange(12):02d}", i, rnd.choice(["x", "y", None]))
        for i in range(n)
    ]


def runs(rows):
    kept = []
    for key in {r[0] for r in rows}:
        before = object()
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if r[3] != before:
                kept.append(r[2])
            before = r[3]
    return sorted(kept)


def test_run_dedupe(spark):
    states = ["s1", "s1", "s2", "s3", "s1", "s1", "s4"]
    df = frame(spark, [("k", f"t{i}", i, s) for i, s in enumerate(states)])
    kept = changes(df, "k", ["ts_text", "seq"], ["v"]).orderBy("seq").collect()
    assert [r["v"] for r in kept] == ["s1", "s2", "s3", "s1", "s4"]
    assert [r["seq"] for r in kept] == [0, 2, 3, 4, 6]


PARTS = [1, 5, 40]


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("seed", [1, 2])
def test_changes_same_for_any_number_of_ranges(spark, parts, seed):
    rows = random_rows(seed)
    kept = changes(frame(spark, rows), "k", ["ts_text", "seq"], ["v"], parts)
    assert sorted(r["seq"] for r in kept.collect()) == runs(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_missing_keys_are_one_group(spark, parts):
    rows = [(None if r[0] == "hot" else r[0], *r[1:]) for r in random_rows(7)]
    kept = changes(frame(spark, rows), "k", ["ts_text", "seq"], ["v"], parts)
    assert sorted(r["seq"] for r in kept.collect()) == runs(rows)


def test_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    rows = random_rows(8)
    kept = changes(frame(spark, rows).withColumn("v", counted("v")), "k", ["ts_text", "seq"], ["v"])
    assert sorted(r["seq"] for r in kept.collect()) == runs(rows) and seen.value == len(rows)


@pytest.mark.parametrize("when", ["2024-01-01 00:00:00", None])
def test_ranges_bound_a_hot_stretch(spark, when):
    """Nine tenths of the rows are one key's within a second, or without any time."""
    rows = [("hot" if i % 10 < 9 else f"k{i}", when if i % 10 < 9 else f"2024-01-{1 + i % 28:02d}", i, str(i // 7 % 3)) for i in range(8000)]
    df = frame(spark, rows)
    ranged = slices.ranged(df, ["k"], ["ts_text", "seq"], 16)
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]
    per_task = [r["count"] for r in slices.dealt(ranged, 16).groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(per_task) == sorted(sizes)
    kept = changes(df, "k", ["ts_text", "seq"], ["v"], 16)
    assert sorted(r["seq"] for r in kept.collect()) == runs(rows)


def test_windows_take_the_ranges_as_they_are(spark):
    plan = slices.numbered(frame(spark, random_rows(9)), ["k"], ["ts_text", "seq"], 6)
    text = plan._jdf.queryExecution().executedPlan().toString()
    window = text[: text.index("BroadcastExchange")]
    assert window.count("Exchange") == 1 and "REPARTITION_BY_NUM" in window


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("parts", [1, 6])
def test_running(spark, parts, last):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "b", None]), f"t{i // 3:03d}", i, rnd.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts_text string, seq bigint, n bigint")
    got = {r["seq"]: r["x"] for r in slices.running(df, ["k"], ["ts_text", "seq"], F.col("n"), "x", parts, last).collect()}
    for k, _, i, _ in rows:
        until = [r[3] for r in rows if r[0] == k and r[2] <= i and r[3] is not None]
        assert got[i] == ((until[-1] if until else None) if last else sum(until))


def test_several_columns_and_new_nulls(spark):
    rows = [("k", "t0", 0, "x", 1), ("k", "t1", 1, "x", 1), ("k", "t2", 2, "x", None), ("k", "t3", 3, None, None)]
    df = spark.createDataFrame(rows, "k string, ts_text string, seq bigint, v string, w int")
    kept = changes(df, "k", ["ts_text", "seq"], ["v", "w"])
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 3]


@pytest.mark.parametrize("parts", PARTS)
def test_numbered(spark, parts):
    rows = random_rows(4)
    placed = slices.numbered(frame(spark, rows), ["k"], ["ts_text", "seq"], parts)
    got = {r["seq"]: r["pos"] for r in placed.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            want[r[2]] = i + 1
    assert got == want


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_next_flagged(spark, parts):
    rnd = random.Random(5)
    rows = [(rnd.choice("aab"), i, rnd.random() < 0.2) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, pos bigint, f boolean")
    got = {r["pos"]: r["_next"] for r in slices.next_flagged(df, ["k"], "pos", "f", parts).collect()}
    for k, pos, _ in rows:
        later = [p for kk, p, f in rows if kk == k and p > pos and f]
        assert got[pos] == (min(later) if later else None)


def test_nested_timeline_parts(spark):
    df = spark.createDataFrame([("e", f"t{i % 7}", i) for i in range(95)], "entity_id string, ts_text string, seq bigint")
    nested = nested_timeline(df, ["ts_text", "seq"], part_chars=2, parts=9).orderBy("part").collect()
    assert [r["part"] for r in nested] == [f"t{i}" for i in range(7)]
    flat = [(x["ts_text"], x["seq"]) for r in nested for x in r["records"]]
    assert [len(r["records"]) for r in nested_timeline(df, ["seq"], part_chars=1, block=40).orderBy("block").collect()] == [40, 40, 15]
    assert flat == sorted(flat) and [x["pos"] for r in nested for x in r["records"]] == list(range(1, 96))


def test_timeline_is_sorted_by_entity_and_time(spark):
    rows = [(e, f"t{i}", i) for e in "ba" for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "entity_id string, ts_text string, seq bigint")
    assert [tuple(r) for r in timeline(df).collect()] == sorted(rows)


def test_history_summary_marks_unknown_entities(spark):
    states = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1")], "entity_id string, ts_text string")
    ops = spark.createDataFrame([("a", "t0")], "entity_id string, ts_text string")
    got = {r["entity_id"]: (r["n_states"], r["n_ops"], r["last_state"]) for r in history_summary(states, ops).collect()}
    assert got == {"a": (2, 1, "t2"), "b": (1, None, "t1")}


def test_history_timeline(spark):
    states = [("a", "t2", 1, "x"), ("a", "t4", 2, "y"), ("b", "t1", 3, "z")]
    ops = [("a", "log", "t1", 4), ("a", "log", "t2", 5), ("a", "db", "t3", 6), ("c", "log", "t1", 7), (None, "log", "t1", 8)]
    left = spark.createDataFrame(states, "entity_id string, ts_text string, seq bigint, state string")
    right = spark.createDataFrame(ops, "entity_id string, source string, ts_text string, seq bigint")
    for parts in (1, 5):
        got = sorted(tuple(r) for r in history_timeline(left, right, ["log", "db"], parts).collect())
        assert sorted(got, key=lambda r: (r[0], r[1], r[2] in (1, 2, 3))) == [
            ("a", "t1", 4, "log", None, None, 1, 0),
            ("a", "t2", 5, "log", None, None, 2, 0),
            ("a", "t2", 1, "state", "x", "t2", 2, 0),
            ("a", "t3", 6, "db", "x", "t2", 2, 1),
            ("a", "t4", 2, "state", "y", "t4", 2, 1),
            ("b", "t1", 3, "state", "z", "t1", None, None),
        ]
