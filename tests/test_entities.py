import re

import pytest
from pyspark.sql import functions as F

from statetrail.functions import search
from statetrail.operators import entities as en
from statetrail.operators.entities import entity_ids, extract_entities, filter_lines, fits_broadcast, match_entities

A = "0cc175b9-c0f1-46b6-831c-399e26977266"
B = "92eb5ffe-e6ae-4fec-8ad7-1c777531578f"


def found(df):
    return sorted((r["seq"], r["entity_id"]) for r in df.collect())


def test_which_text_is_an_id(lines):
    bare = A.replace("-", "")
    df = lines(
        f"x {A} y {A} z {B}",
        f"bare {bare}",
        f"capital {A.upper()}",
        f"inside ff{A}ff",
        f"version {A[:14]}5{A[15:]}",
        f"variant {A[:19]}7{A[20:]}",
        "nothing",
    )
    assert found(extract_entities(df)) == sorted([(0, A), (0, B), (1, bare), (3, A)])
    plain = found(extract_entities(df, normalize=True))
    assert (2, bare) in plain and (0, bare) in plain and (1, bare) in plain


@pytest.mark.parametrize("broadcast", [True, False, "auto"])
def test_match(spark, lines, broadcast):
    ids = spark.createDataFrame([(A,), (A,)], "entity_id string")
    df = lines(f"{A} {B}", B, f"{A} {A}", A.replace("-", ""))
    assert found(match_entities(df, ids, broadcast=broadcast)) == [(0, A), (2, A)]
    same = found(match_entities(df, ids, broadcast=broadcast, normalize=True))
    assert [s for s, _ in same] == [0, 2, 3]


def test_line_with_two_ids_counts_twice_but_filters_once(spark, lines):
    ids = spark.createDataFrame([(A,), (B,)], "entity_id string")
    df = lines(f"{A} {B}", "none", f"{A} {B}")
    assert len(found(match_entities(df, ids))) == 4
    assert sorted(r["seq"] for r in filter_lines(df, ids, key=["seq"]).collect()) == [0, 2]


def test_broadcast_only_within_bound(spark):
    ids = spark.range(11).selectExpr("cast(id as string) AS entity_id")
    assert fits_broadcast(ids, 11 * 24 + 12) and not fits_broadcast(ids, 11 * 24 + 11)
    assert fits_broadcast(ids.limit(0), 0)


def test_many_ids_join_by_shuffle(spark, lines):
    ids = spark.createDataFrame([(A,), (B,)], "entity_id string")
    joined = match_entities(lines(A, B, B), ids, max_broadcast_bytes=1)
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    assert found(joined) == [(0, A), (1, B), (2, B)]


def test_entity_ids(spark):
    df = spark.createDataFrame([(A, 1), (A, 2), (B, 3)], "entity_id string, n int")
    assert sorted(r[0] for r in entity_ids(df).collect()) == sorted([A, B])


@pytest.mark.parametrize("listed_bytes", [1_000_000, 0])
def test_lines_find_all_their_ids_and_are_parsed_once(spark, listed_bytes):
    ids = [f"0cc175b9-c0f1-46b6-831c-{i:012d}" for i in range(300)]
    texts = [f"x {ids[i]} y {ids[(i * 7) % 300]} z {ids[i]}" for i in range(300)] + ["nothing", None]
    given = spark.createDataFrame(list(enumerate(texts)), "seq bigint, value string").repartition(3)
    some = ids[::3]
    wanted = en.wanted_ids(spark.createDataFrame([(i,) for i in [*some, some[0], None, "not an id"]], "entity_id string"), listed_bytes)
    assert (wanted.listed is None) == (listed_bytes == 0)
    found = en.match_lines(given, wanted)
    got = {r["seq"]: r["entity_ids"] for r in found.collect()}
    want = {i: [u for u in dict.fromkeys(en_ids(t)) if u in some] for i, t in enumerate(texts[:300])}
    assert got == {i: u for i, u in want.items() if u}
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed(text):
        calls.add(1)
        return text[:1]

    rows = en.per_entity(found.withColumn("p", parsed("value"))).select("seq", "entity_id", "p").collect()
    assert calls.value == len(got) and len(rows) == sum(map(len, got.values()))


def en_ids(text):
    return re.findall(r"[0-9a-f-]{36}", text)


def test_no_wanted_ids_match_nothing(spark):
    given = spark.createDataFrame([(1, "0cc175b9-c0f1-46b6-831c-399e26977266")], "seq bigint, value string")
    none = spark.createDataFrame([], "entity_id string")
    assert en.match_lines(given, none).count() == 0 and en.match_lines(given, None).count() == 1


def test_bloom_filter_holds_all_and_little_else(spark):
    values = spark.range(5000).select(F.col("id").cast("string").alias("v"))
    words = search.bloom_words(values, "v", 1 << 16)
    assert len(words) == 1 << 10
    held = spark.range(15_000).select("id", search.may_hold(words, F.col("id").cast("string"), 1 << 16).alias("m"))
    assert held.where("id < 5000 and m").count() == 5000 and held.where("id >= 5000 and m").count() < 500


def test_bloom_filter_comes_before_the_shuffle(spark):
    given = spark.createDataFrame([(1, "0cc175b9-c0f1-46b6-831c-399e26977266")], "seq bigint, value string")
    plan = en.match_entities(given, given.selectExpr("value as entity_id"), broadcast=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("getbit")
