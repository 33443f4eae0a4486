"""Stored logs that a search skips, sketches that merge, rings, and verdicts counted while writing."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import logs, metrics, quality, sharding
from millrace.operators.sharding import ShardSpec
from millrace.session import scratch
from millrace.sources import sinks


def rows_read(df):
    """Rows that the scan of ``df`` handed on, after row groups and pages were skipped."""
    execution = df._jdf.queryExecution()
    found = execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    return found, leaves.apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def stored(spark):
    ids = spark.range(200_000).select(F.col("id").alias("log_id"), ((F.col("id") * 7919) % 5000).alias("pipeline_id"), F.concat(F.lit("t-"), F.md5(F.col("id").cast("string"))).alias("task_id"))
    rows = ids.withColumn("timestamp", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("log_id")).cast("timestamp_ntz")).withColumn("message", F.lit("x" * 40))
    path = scratch(spark, "stored")
    logs.store(rows, path, ["pipeline_id", "task_id"], group_bytes=64 << 10)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize(
    "criteria",
    [
        {"pipeline_id": 77},
        {"pipeline_id": 77, "start": "2024-01-02", "end": "2024-01-02 12:00:00"},
        {"task_id": "t-81dc9bdb52d04dc20036dbd8313ed055"},
        {"task_id": "t-nobody"},
    ],
)
def test_a_search_skips_nine_tenths(stored, criteria):
    rows, table = stored
    found, read = rows_read(logs.search(table, **criteria))
    assert found == logs.search(rows, **criteria).count()
    assert read * 10 <= 200_000


def test_day_and_minute_bounds_are_inclusive(stored):
    rows, table = stored
    span = {"start": "2024-01-01 23:59:59", "end": "2024-01-02 00:00:01"}
    assert logs.search(table, **span).count() == logs.search(rows, **span).count() == 3


def test_quantiles_from_merged_sketches(spark):
    values = spark.range(50_000).select(
        F.lit("m").alias("metric"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("label"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"), F.pmod(F.col("id") * 48271, F.lit(50_021)).cast("double").alias("value"),
    )
    values = values.unionByName(values.limit(1).withColumn("value", F.lit(None).cast("double")))
    hours = metrics.sketched(values, ["label"], "1 hour")
    assert hours.count() == 28
    for row in metrics.merged_quantiles(hours, ["label"], [0.0, 0.5, 0.99, 1.0]).collect():
        own = values.where((F.col("label") == row["label"]) & F.col("value").isNotNull())
        n, upto = own.agg(F.count("*"), F.count_if(F.col("value") <= row["value"])).first()
        assert row["n"] == n
        assert abs(upto / n - row["quantile"]) < 0.01


@pytest.mark.parametrize("shards, virtual", [(1, 1), (3, 1), (5, 7), (16, 64)])
def test_ring_finds_the_next_virtual_node(spark, shards, virtual):
    import hashlib

    nodes = sharding.ring(shards, virtual)
    assert len(nodes) == shards * virtual
    keys = [f"key-{k}" for k in range(300)] + [""]
    placed = spark.createDataFrame([(k,) for k in keys], "key string")
    found = {r["key"]: r["shard_id"] for r in sharding.shard(placed, ShardSpec(shards, "ring", virtual_nodes=virtual)).collect()}
    for key in keys:
        place = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
        assert found[key] == next((s for at, s in nodes if at >= place), nodes[0][1])


def test_a_null_key_has_no_place_on_the_ring(spark):
    row = spark.createDataFrame([(None,)], "key string").select(sharding.ring_shard(F.col("key"), 4).alias("s")).first()
    assert row["s"] is None


def test_verdict_counted_while_writing(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "", 2.0), (3, None, math.nan), (4, "d", None)], "id long, name string, score double").repartition(3)
    path = scratch(spark, "judged")
    judged = quality.judged_while(rows, rows.columns, lambda df: sinks.write(df, path)).first()
    apart = quality.verdict(quality.scores(rows, rows.columns)).first()
    assert {c: judged[c] for c in judged.__fields__} == {c: apart[c] for c in judged.__fields__}
    assert spark.read.parquet(path).count() == 4


def test_verdict_of_no_rows(spark):
    empty = spark.createDataFrame([], "id long, name string")
    judged = quality.judged_while(empty, empty.columns, lambda df: df.write.format("noop").mode("overwrite").save()).first()
    assert judged["record_count"] == 0 and not judged["valid"]
