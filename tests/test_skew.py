"""Hot keys, ties, nulls and many slices: sliced operators against plain windows."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import gather, joins, metrics, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to one key, some keys are null, times repeat."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    seconds = F.pmod(F.xxhash64("id"), F.lit(86_400))
    return spark.range(5_000).select(
        "id",
        key.alias("key"),
        F.timestamp_seconds(F.lit(1_704_067_200) + seconds).cast("timestamp_ntz").alias("ts"),
        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(90)).alias("value"),
    )


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(columns) == sorted(b.columns)
    left, right = a.select(columns), b.select(columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("unit", ["minute", "hour", "year"])
def test_numbering(skewed, keys, unit):
    order = [F.col("ts"), F.col("id")]
    plain = skewed.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    same(ordering.numbered(skewed, order, ordering.time_slice("ts", unit), keys), plain)


def test_numbering_backwards(skewed):
    order = [F.col("ts").desc(), F.col("id").desc()]
    plain = skewed.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint"))
    same(ordering.numbered(skewed, order, ordering.time_slice("ts"), ["key"], descending=True), plain)


@pytest.mark.parametrize("unit", ["minute", "hour"])
def test_previous_value(skewed, unit):
    window = Window.partitionBy("key").orderBy("ts", "id")
    same(
        ordering.with_previous(skewed, "value", ["ts", "id"], ordering.time_slice("ts", unit), ["key"]),
        skewed.withColumn("previous", F.lag("value").over(window)),
    )


def test_running_total(skewed):
    window = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(
        ordering.running_total(skewed, "value", [F.col("ts"), F.col("id")], ordering.time_slice("ts"), ["key"]),
        skewed.withColumn("running", F.sum("value").over(window)),
    )


@pytest.mark.parametrize("count", [1, 7, 400, 10_000])
def test_keeping_the_newest(skewed, count):
    order = [F.col("ts").desc(), F.col("id").desc()]
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    plain = skewed.withColumn("rank", rank).where(F.col("rank") <= count).drop("rank")
    same(ordering.keep_newest(skewed, count, order, ["key"], ordering.time_slice("ts")), plain)


def test_children_of_a_hot_parent(spark, skewed):
    parents = spark.createDataFrame([("hot", 1), ("k1", 2), ("lonely", 3)], "name string, n int")
    same(joins.with_children(parents, skewed, "name", "key"), parents.join(skewed, parents["name"] == skewed["key"], "left"))


def test_folding_with_python_and_numpy(skewed):
    rows = skewed.select("key", (F.col("value") * 6 + 12).alias("d"), F.lit(1).cast("bigint").alias("n"))
    folded = {r["key"]: (r["d"], r["n"]) for r in gather.fold(rows, ["key"], {"d": math.gcd, "n": np.add}).collect()}
    expected = {}
    for r in rows.collect():
        d, n = expected.get(r["key"], (0, 0))
        expected[r["key"]] = (math.gcd(d, r["d"]), n + 1)
    assert folded == expected


def test_folding_over_small_batches(spark, skewed):
    rows = skewed.select("key", "value").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded = {r["key"]: r["value"] for r in gather.fold(rows, ["key"], {"value": np.maximum}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folded == {r["key"]: r["m"] for r in rows.groupBy("key").agg(F.max("value").alias("m")).collect()}


@pytest.mark.parametrize("spread", [1, 3, 64])
def test_folding_one_group_of_nearly_all_rows(spark, spread):
    rows = spark.range(0, 20_000, 1, 16).select(F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(-1).alias("key"), F.col("id").alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        folded = {r["key"]: r["x"] for r in gather.fold(rows, ["key"], {"x": np.add}, spread).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folded == {r["key"]: r["s"] for r in rows.groupBy("key").agg(F.sum("x").alias("s")).collect()}


def test_exact_quantiles_of_a_hot_label(skewed):
    samples = skewed.select(F.lit("m").alias("metric"), F.coalesce("key", F.lit("-")).alias("l"), F.col("value").cast("double").alias("value"))
    found = {(r["l"], r["quantile"]): r["value"] for r in metrics.summary(samples, ["l"], [0.0, 0.25, 1.0], 7.0).collect()}
    groups = samples.toPandas().groupby("l")["value"]
    for (label, q), value in found.items():
        assert math.isclose(value, groups.get_group(label).quantile(q), abs_tol=1e-9)


def test_sessions_of_a_hot_worker(skewed):
    beats = skewed.where("key is not null").select(F.col("key").alias("worker_id"), F.col("ts").alias("timestamp"))
    sessions = metrics.activity_sessions(beats, 60).toPandas()
    for worker, group in beats.toPandas().groupby("worker_id"):
        times = group["timestamp"].sort_values()
        starts = times[(times.diff().dt.total_seconds() > 60) | times.diff().isna()]
        mine = sessions[sessions["worker_id"] == worker].sort_values("session_start")
        assert list(mine["session_start"]) == list(starts) and mine["beats"].sum() == len(times)
