"""Streams over several files: micro-batches, late rows and restarts."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, ordering
from millrace.operators.validation import FieldRule
from millrace.session import scratch
from millrace.streaming import jobs, tables


@pytest.fixture()
def folder(spark, tmp_path):
    """Write a frame as one more file of a stream folder; files are taken in the order they were written."""
    path = tmp_path / "in"
    path.mkdir()
    count = [0]

    def add(df):
        import os
        import shutil

        out = tmp_path / f"part{count[0]}"
        df.coalesce(1).write.parquet(str(out))
        (file,) = out.glob("*.parquet")
        target = path / f"{count[0]:04d}.parquet"
        shutil.copy(file, target)
        os.utime(target, (1_700_000_000 + count[0], 1_700_000_000 + count[0]))
        count[0] += 1

    return str(path), add


def beats(spark, rows):
    return spark.createDataFrame(rows, "beat_id bigint, worker_id bigint, at string, status string, tasks_running bigint").select(
        "beat_id", "worker_id", F.col("at").cast("timestamp_ntz").alias("timestamp"), "status", "tasks_running"
    )


def test_state_over_micro_batches(spark, folder):
    path, add = folder
    first = beats(spark, [(1, 1, "2024-01-01 00:00:00", "running", 3), (2, 2, "2024-01-01 00:00:05", "running", 1)])
    second = beats(spark, [(3, 1, "2024-01-01 00:00:20", "lost", 0)])
    add(first)
    add(second)
    stream = tables.stream_source(spark, path, first.schema, files_per_batch=1)
    written = jobs.run(jobs.track_liveness, stream)
    assert written.select("batch_id").distinct().count() == 2
    state = tables.newest_state(written, ["worker_id"])
    alive = {r["worker_id"]: r["alive"] for r in metrics.liveness(state, "2024-01-01 00:00:30").collect()}
    assert alive == {1: 0, 2: 1}
    late = {r["worker_id"]: r["alive"] for r in metrics.liveness(state, "2024-01-01 00:01:00").collect()}
    assert late == {1: 0, 2: 0}


def test_late_rows_are_cut_and_copies_too(spark, folder):
    path, add = folder
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00")]
    later = [(3, "2024-01-01 01:00:00"), (4, "2024-01-02 20:00:00"), (2, "2024-01-03 00:00:00")]
    for part in (rows, [(9, "2024-01-03 00:00:01")], later):
        add(spark.createDataFrame(part, "log_id bigint, t string").select("log_id", F.col("t").cast("timestamp_ntz").alias("timestamp")))
    stream = tables.stream_source(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    kept = jobs.run(jobs.cut_late, stream, "log_id")
    assert sorted(r["log_id"] for r in kept.collect()) == [1, 2, 4, 9]


def test_restart_takes_only_new_files(spark, folder):
    path, add = folder
    schema = "execution_id bigint, status string"
    add(spark.createDataFrame([(1, "completed"), (1, "running"), (2, "failed")], schema))
    table, progress = scratch(spark, "t"), scratch(spark, "p")

    def step():
        stream = tables.stream_source(spark, path, spark.read.parquet(path).schema)
        jobs.roll_up_executions(stream, table, progress)
        state = tables.newest_state(spark.read.parquet(table), ["execution_id"])
        return {r["execution_id"]: (r["total"], r["status"]) for r in state.collect()}

    assert step() == {1: (2, "running"), 2: (1, "failed")}
    assert step() == {1: (2, "running"), 2: (1, "failed")}
    add(spark.createDataFrame([(2, "completed"), (3, "completed")], schema))
    assert step() == {1: (2, "running"), 2: (2, "failed"), 3: (1, "completed")}


def test_sessions_over_micro_batches_match_the_table(spark, folder):
    path, add = folder
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:25", "2024-01-01 00:02:00", "2024-01-01 00:02:31", "2024-01-01 00:03:01"]
    frames = [beats(spark, [(i, 1, at, "running", 0)]) for i, at in enumerate(times)]
    for frame in frames:
        add(frame)
    stream = tables.stream_source(spark, path, frames[0].schema, files_per_batch=1)
    slots = tables.newest_state(jobs.run(jobs.track_sessions, stream, gap_seconds=30, delay="12 hours"), ["worker_id", "slot"])
    streamed = metrics.join_slots(slots, 30).select("session", "beats").orderBy("session").collect()
    batch = metrics.activity_sessions(spark.read.parquet(path), 30).select("session", "beats").orderBy("session").collect()
    assert streamed == batch and [r["beats"] for r in batch] == [2, 1, 2]


def test_quarantine_splits_the_input(spark, folder):
    path, add = folder
    df = spark.createDataFrame([(1, "fine text"), (2, ""), (3, None)], "id bigint, text string")
    add(df)
    out = jobs.run(jobs.quarantine, tables.stream_source(spark, path, df.schema), [FieldRule("text", required=True, min_length=1)])
    assert {r["id"]: r["side"] for r in out.collect()} == {1: "main", 2: "quarantine", 3: "quarantine"}


def test_missing_times_are_stamped(spark, folder):
    path, add = folder
    df = spark.sql("SELECT 1L AS log_id, cast(null AS timestamp_ntz) AS timestamp")
    add(df)
    row = jobs.run(jobs.collect_logs, tables.stream_source(spark, path, df.schema)).collect()[0]
    assert row["timestamp"] is not None and row["day"] == row["timestamp"].date()


def test_transfer_batches_are_flushed_per_micro_batch(spark, folder):
    path, add = folder
    for start in (0, 5):
        add(spark.range(start, start + 5).select("id", F.lit("xy").alias("payload")))
    stream = tables.stream_source(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = jobs.run(jobs.account_transfers, stream, "payload", "id", ordering.id_slice("id"), batch_size=3).collect()
    assert sorted((r["batch_id"], r["batch"], r["records"], r["bytes"]) for r in out) == [
        (0, 0, 3, 14), (0, 1, 2, 12), (1, 0, 3, 14), (1, 1, 2, 12),
    ]


@pytest.mark.parametrize("rows_a_file", [1 << 19, 100])
def test_a_span_is_one_micro_batch(spark, monkeypatch, rows_a_file):
    """However many partitions the rows come in, and however many files a span needs."""
    monkeypatch.setattr(tables, "ROWS_A_FILE", rows_a_file)
    rows = spark.range(900).repartition(6).select("id", F.timestamp_seconds(F.col("id")).alias("timestamp"))
    path = scratch(spark, "out")
    tables.each_batch(tables.sliced(rows, "timestamp", scratch(spark, "in"), 3), path, scratch(spark, "progress"))
    spans = spark.read.parquet(path).groupBy(tables.BATCH).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    assert [tuple(r) for r in spans.orderBy("low").select("low", "high", "n").collect()] == [(0, 299, 300), (300, 599, 300), (600, 899, 300)]
