"""Slices by observed sizes: even for scattered and for crowded values, the same order as the values."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import documents, ordering

N = 40_000
SHAPES = {
    "random 63 bit ids": "xxhash64(id) & 9223372036854775807",
    "all within 1.0": "id / 40000.0D",
    "mostly in one second": "timestamp_micros(CASE WHEN id % 10 = 0 THEN id * 1000000000 ELSE id * 7 END)",
    "a few far away": "CASE WHEN id < 5 THEN -id * 100000000000000000 ELSE id END",
    "days": "date_add(DATE '2020-01-01', CAST(id % 5000 AS INT))",
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_slices_are_even_and_ordered(spark, shape):
    rows = spark.range(N).selectExpr("id", f"{SHAPES[shape]} AS v")
    cut = rows.withColumn("s", ordering.observed_slice(rows, "v", rows=1000, most=256))
    sizes = cut.groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()
    assert 20 <= len(sizes) <= 41
    assert max(r["n"] for r in sizes) < 2500
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))


def test_positions_over_scattered_ids(spark):
    rows = spark.range(5000).selectExpr(f"{SHAPES['random 63 bit ids']} AS v")
    placed = ordering.numbered(rows, [F.col("v")], ordering.observed_slice(rows, "v", rows=100)).collect()
    assert [r["v"] for r in sorted(placed, key=lambda r: r["position"])] == sorted(r["v"] for r in placed)
    assert sorted(r["position"] for r in placed) == list(range(1, 5001))


def test_nulls_ties_and_empty_tables(spark):
    empty = spark.createDataFrame([], "v long, t string")
    assert documents.batch_totals(empty, "t", "v").count() == 0
    nulls = spark.createDataFrame([(None,)] * 3, "v long")
    assert {r["s"] for r in nulls.select(ordering.observed_slice(nulls, "v").alias("s")).collect()} == {-1}
    ties = spark.range(100).select(F.when(F.col("id") < 90, 7).when(F.col("id") < 95, F.col("id")).alias("v"))
    cut = ties.select("v", ordering.observed_slice(ties, "v", rows=10).alias("s"))
    assert cut.where("v = 7").select("s").distinct().count() == 1
    placed = ordering.numbered(ties, [F.col("v")], ordering.observed_slice(ties, "v", rows=10)).collect()
    assert sorted(r["position"] for r in placed) == list(range(1, 101))
    assert all(r["position"] <= 5 for r in placed if r["v"] is None)
