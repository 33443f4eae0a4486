"""Streams with timers: completion, silence and late rows over micro-batches."""

import pytest
from pyspark.sql import functions as F

from millrace.session import scratch
from millrace.streaming import stateful, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("timestamp", F.col("at").cast("timestamp_ntz")).drop("at")


def streamed(spark, batches, schema):
    """A stream of one file per micro-batch."""
    path = scratch(spark, "in")
    for rows in batches:
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(path)
    return tables.stream_source(spark, path, frame(spark, [], schema).schema, files_per_batch=1)


EXEC, TASK, BEAT = "execution_id long, expected long, at string", "execution_id long, status string, at string", "worker_id long, at string"


def test_executions_complete_once_and_leave_no_state(spark):
    started = streamed(
        spark,
        [[(1, 2, "2024-01-01 00:00:00"), (2, 2, "2024-01-01 00:00:01"), (5, 0, "2024-01-01 00:00:02")], [(3, 3, "2024-01-01 00:10:00")], [(None, None, "2024-01-03 00:00:00")]],
        EXEC,
    )
    ended = streamed(
        spark,
        [
            [(1, "completed", "2024-01-01 00:01:00"), (4, "completed", "2024-01-01 00:01:30"), (1, "running", "2024-01-01 00:01:10")],
            [(1, "completed", "2024-01-01 00:11:00"), (2, "completed", "2024-01-01 00:11:00"), (2, "failed", "2024-01-01 00:09:00"), (3, "failed", "2024-01-01 00:12:00")],
            [(None, None, "2024-01-03 00:00:00")],
        ],
        TASK,
    )
    path, progress = scratch(spark, "stream"), scratch(spark, "progress")
    last = stateful.complete_executions(started, ended, path, progress, "1 hour", 7200)
    rows = {r["execution_id"]: (r["tasks"], r["failed"], str(r["ended_at"]), r["status"]) for r in spark.read.parquet(path).collect()}
    assert rows == {
        1: (2, 0, "2024-01-01 00:11:00", "completed"),
        2: (2, 1, "2024-01-01 00:11:00", "failed"),
        3: (1, 1, "2024-01-01 00:12:00", "timed_out"),
        4: (1, 0, "2024-01-01 00:01:30", "timed_out"),
        5: (0, 0, "1970-01-01 00:00:00", "completed"),
    }
    assert last["stateOperators"][0]["numRowsTotal"] == 0


def test_silent_workers_by_timer(spark):
    beats = streamed(
        spark,
        [
            [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:00:00"), (2, "2024-01-01 00:05:00")],
            [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:02:00"), (3, "2024-01-01 00:10:00")],  # one beat out of order
            [(3, "2024-01-01 00:10:30"), (2, "2024-01-01 02:00:00")],
            [(None, "2024-01-02 00:00:00")],
        ],
        BEAT,
    )
    path, progress = scratch(spark, "stream"), scratch(spark, "progress")
    last = stateful.watch_silence(beats, path, progress, "10 minutes", 30, 3600)
    told = tables.newest_state(spark.read.parquet(path), ["worker_id", "went_at"]).collect()
    rows = {(r["worker_id"], f"{r['went_at']:%H:%M:%S}", r["back_at"] and f"{r['back_at']:%H:%M:%S}") for r in told}
    assert rows == {
        (1, "00:00:50", "00:10:00"), (1, "00:10:30", None),
        (2, "00:00:30", "00:02:00"), (2, "00:02:30", "00:05:00"), (2, "00:05:30", None), (2, "02:00:30", None),  # away for too long to be known
        (3, "00:11:00", None),
    }
    assert last["stateOperators"][0]["numRowsTotal"] == 0


def test_open_executions_share_buckets_of_state(spark):
    n = 3000
    started = streamed(spark, [[(k, 2, "2024-01-01 00:00:00") for k in range(n)]], EXEC)
    ended = streamed(spark, [[(k, "failed" if k % 3 else "completed", "2024-01-01 00:01:00") for k in range(n) for _ in range(1 + k % 2)]], TASK)
    path, progress = scratch(spark, "stream"), scratch(spark, "progress")
    last = stateful.complete_executions(started, ended, path, progress, "1 hour", 7200)
    assert 0 < last["stateOperators"][0]["numRowsTotal"] <= stateful.BUCKETS < n // 2
    rows = spark.read.parquet(path).collect()
    assert {(r["execution_id"], r["tasks"], r["failed"], r["status"]) for r in rows} == {
        (k, 2, 2 if k % 3 else 0, "failed" if k % 3 else "completed") for k in range(1, n, 2)
    }
    assert len(rows) == n // 2


def test_ids_beyond_doubles_stay_apart(spark):
    """An id above 2 to the 53, and one that waits for its other task beside one that ends."""
    big = (1 << 53) + 1
    started = streamed(spark, [[(big, 1, "2024-01-01 00:00:00"), (big + 1, 2, "2024-01-01 00:00:00")]], EXEC)
    ended = streamed(spark, [[(big, "completed", "2024-01-01 00:01:00"), (big + 1, "completed", "2024-01-01 00:01:00")]], TASK)
    path, progress = scratch(spark, "stream"), scratch(spark, "progress")
    stateful.complete_executions(started, ended, path, progress, "1 hour", 7200)
    assert [tuple(r)[:2] for r in spark.read.parquet(path).select("execution_id", "tasks").collect()] == [(big, 1)]


def test_watched_workers_share_buckets_of_state(spark):
    n = 2500
    beats = streamed(
        spark, [[(k, "2024-01-01 00:00:00") for k in range(n)], [(k, "2024-01-01 00:20:00") for k in range(0, n, 2)], [(None, "2024-01-01 00:40:00")]], BEAT
    )
    path, progress = scratch(spark, "stream"), scratch(spark, "progress")
    last = stateful.watch_silence(beats, path, progress, "10 minutes", 30, 3600)
    assert 0 < last["stateOperators"][0]["numRowsTotal"] <= stateful.BUCKETS < n
    told = tables.newest_state(spark.read.parquet(path), ["worker_id", "went_at"]).collect()
    rows = {(r["worker_id"], f"{r['went_at']:%H:%M:%S}", r["back_at"] and f"{r['back_at']:%H:%M:%S}") for r in told}
    odd = {(k, "00:00:30", None) for k in range(1, n, 2)}
    assert rows == odd | {(k, "00:00:30", "00:20:00") for k in range(0, n, 2)} | {(k, "00:20:30", None) for k in range(0, n, 2)}


def test_a_worker_must_be_silent_before_it_is_forgotten(spark):
    with pytest.raises(ValueError):
        stateful.watch_silence(spark.range(0), "", "", "1 second", 30, 30)


def test_late_rows_are_counted_aside_and_a_rerun_replaces(spark):
    schema = "metric string, label string, value double, at string"
    stream = streamed(
        spark,
        [
            [("m", "a", 1.0, "2024-01-01 00:00:10"), ("m", "a", 2.0, "2024-01-01 01:00:00")],
            [("m", "a", 4.0, "2024-01-01 00:10:00"), ("m", "b", 8.0, "2024-01-01 00:50:00"), ("m", "b", 16.0, "2024-01-01 03:00:00")],
            [("m", "a", 32.0, "2024-01-01 00:59:59"), ("m", None, 64.0, "2024-01-01 02:40:00")],
        ],
        schema,
    )
    path, progress = scratch(spark, "stream"), scratch(spark, "progress")
    stateful.count_with_late(stream, ["label"], path, progress, 60, 1800)
    late = sorted(r["value"] for r in spark.read.parquet(f"{path}/late").collect())
    assert late == [4.0, 32.0]  # the batch before them had 01:00 and 03:00
    counted = stateful.counted(spark.read.parquet(f"{path}/on_time"), ["label"])
    assert counted.agg(F.sum("n"), F.sum("total")).collect()[0] == (5, 91.0)
    again = scratch(spark, "progress")  # a lost checkpoint runs every batch again: the same folders, nothing twice
    stateful.count_with_late(stream, ["label"], path, again, 60, 1800)
    assert stateful.counted(spark.read.parquet(f"{path}/on_time"), ["label"]).agg(F.sum("total")).collect()[0][0] == 91.0
    assert sorted(r["value"] for r in spark.read.parquet(f"{path}/late").collect()) == late
