"""Plans under skew: one entity holds most rows, adaptive execution spreads it."""

import pytest
from pyspark.sql import functions as F

from statetrail.operators.entities import match_entities
from statetrail.operators.lookback import lookback, lookback_status
from statetrail.operators.snapshots import rekey
from statetrail.operators.timeline import timeline

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "5KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, n, every, parts=8):
    """Entity and second of day; a third of the rows belong to one entity and one minute."""
    hot = F.col("id") % 3 == 0
    entity = F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("e"), (F.col("id") % 97).cast("string")))
    second = F.when(hot, F.col("id") % 60).otherwise(F.col("id") * every % 86_400)
    clock = F.substring(F.timestamp_seconds(second).cast("timestamp_ntz").cast("string"), 12, 8)
    return spark.range(0, n, 1, parts).select(
        entity.alias("entity_id"),
        F.concat(F.lit("2024-01-01 "), clock, F.lit(".000")).alias("ts_text"),
        F.col("id").alias("seq"),
    )


def test_hot_bin_is_split_in_the_join(skewed):
    states = rows(skewed, 600, 7)
    ops = rows(skewed, 60_000, 1).withColumns({"source": F.lit("log"), "payload": F.md5(F.col("seq").cast("string"))})
    pairs = lookback(states, ops, 300)
    n = pairs.agg(F.count("*").alias("n"), F.max("payload"))
    assert n.collect()[0]["n"] > 1_000_000
    assert "skew=true" in final_plan(n)


def test_verdicts_keep_the_hot_entity_spread(skewed):
    states = rows(skewed, 60_000, 1).withColumn("state", F.md5(F.col("seq").cast("string")))
    ops = rows(skewed, 3_000, 5).withColumns({"source": F.lit("log"), "payload": F.lit("p")})
    verdicts = lookback_status(states, ops, ["log"])
    counted = verdicts.groupBy("status").agg(F.count("*"), F.max("state"))
    assert sum(r[1] for r in counted.collect()) == 60_000
    assert "skew=true" in final_plan(counted)


def test_hot_id_is_split_when_ids_join_by_shuffle(skewed):
    uuid = "0cc175b9-c0f1-46b6-831c-399e26977266"
    other = F.concat(F.lit("0cc175b9-c0f1-46b6-831c-"), F.lpad((F.col("id") % 97).cast("string"), 12, "0"))
    entity = F.when(F.col("id") % 3 == 0, F.lit(uuid)).otherwise(other)
    lines = skewed.range(0, 60_000, 1, 8).select("id", F.concat(entity, F.md5(F.col("id").cast("string"))).alias("value"))
    ids = lines.select(F.substring("value", 1, 36).alias("entity_id")).distinct()
    matched = match_entities(lines, ids, broadcast=False).agg(F.count("*"), F.max("value"))
    assert matched.collect()[0][0] == 60_000
    assert "skew=true" in final_plan(matched)


def test_hot_record_is_split_when_rekeyed(skewed, tmp_path):
    cols = F.create_map(F.lit("external_ids"), F.lit('["map",[["iface-id","if-1"]]]'), F.lit("x"), F.md5(F.col("seq").cast("string")))
    rows(skewed, 60_000, 1).withColumnRenamed("entity_id", "record_id").withColumn("cols", cols).write.parquet(str(tmp_path / "r"))
    keyed = rekey(skewed.read.parquet(str(tmp_path / "r"))).agg(F.count("*"), F.max(F.col("cols")["x"]))
    assert keyed.collect()[0][0] == 60_000
    assert "skew=true" in final_plan(keyed)


def test_hot_timeline_is_split_for_writing(skewed, tmp_path):
    records = rows(skewed, 60_000, 1).withColumn("payload", F.md5(F.col("seq").cast("string")))
    timeline(records).write.parquet(str(tmp_path / "out"))
    written = skewed.read.parquet(str(tmp_path / "out"))
    hot = written.filter("entity_id = 'hot'").select(F.input_file_name().alias("f"), "ts_text", "seq", F.monotonically_increasing_id().alias("i"))
    assert written.count() == 60_000
    files = {}
    for r in hot.orderBy("f", "i").collect():
        files.setdefault(r["f"], []).append((r["ts_text"], r["seq"]))
    assert len(files) > 1
    assert all(v == sorted(v) for v in files.values())
    spans = sorted((v[0], v[-1]) for v in files.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    placed = written.filter("entity_id <> 'hot'").select("entity_id", F.input_file_name().alias("f"))
    cold = placed.groupBy("entity_id").agg(F.count_distinct("f").alias("n"))
    assert cold.filter("n > 1").count() < 20
