import random

import pytest
from pyspark.sql import functions as F

from statetrail.operators.runs import extend_runs, history_of, runs_of

SCHEMA = "k string, ts_text string, seq bigint, digest string"


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        now = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if now is None or now[1] != r[3]:
                now = [key, r[3], r[1:3], r[1:3], 0]
                out.append(now)
            now[3], now[4] = r[1:3], now[4] + 1
    return sorted((str(k), d, f, l, n) for k, d, f, l, n in out)


def got(runs):
    return sorted((str(r["k"]), r["digest"], tuple(r["first"]), tuple(r["last"]), r["n"]) for r in runs.collect())


def some(rnd, n, start, keys=("hot", "hot", "hot", "a", None), span=40, states="xxxy"):
    return [(rnd.choice(keys), f"t{rnd.randrange(span):03d}", start + i, rnd.choice(states)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_repair_the_history(spark, seed):
    rnd = random.Random(seed)
    rows, stored = some(rnd, 150, 0), None
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    stored = runs_of(frame(rows), ["k"], ["ts_text", "seq"])
    assert got(stored) == brute(rows)
    for keys, span in ((("hot", "b"), 40), (("hot", None), 60)):
        more = some(rnd, 25, len(rows) + 1000, keys, span)
        stored = extend_runs(stored, runs_of(frame(more), ["k"], ["ts_text", "seq"]), frame(rows), frame(more), ["k"], ["ts_text", "seq"])
        rows = rows + more
        assert got(stored) == brute(rows)
    firsts = history_of(stored).select("k", "ts_text", "seq").collect()
    assert sorted((str(r["k"]), r["ts_text"], r["seq"]) for r in firsts) == sorted((k, *f) for k, _, f, _, _ in brute(rows))


def test_rows_in_order_read_no_stored_rows(spark):
    old = [("a", f"t{i:02d}", i, "xy"[i // 5 % 2]) for i in range(20)] + [("z", "t00", 0, "x")]
    new = [("a", f"t{i:02d}", i, "yx"[i // 7 % 2]) for i in range(20, 40)]
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(d):
        read.add(1)
        return d

    stored_rows = frame(old).withColumn("digest", seen("digest"))
    args = (["k"], ["ts_text", "seq"])
    runs = extend_runs(runs_of(frame(old), *args), runs_of(frame(new), *args), stored_rows, frame(new), *args)
    assert got(runs) == brute(old + new) and read.value == 0
