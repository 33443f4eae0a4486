"""State tables folded into a base: equal results, reruns, and an end between write and switch."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.streaming import tables
from millrace.streaming.compaction import compact, stored_state

BATCHES, WORKERS = 50, 40


def change(spark, path, batch):
    """What a micro-batch leaves: every third worker's state, null for some."""
    ids = spark.range(batch % 3, WORKERS, 3, 1)
    seen = F.when(F.col("id") % 7 != 0, F.col("id") * 1000 + batch)
    ids.select(F.when(F.col("id") != 6, F.col("id")).alias("worker_id"), seen.alias("seen")).write.mode("overwrite").parquet(f"{path}/{tables.BATCH}={batch}")


def newest(batches):
    last = {}
    for batch in range(batches):
        last |= {(None if k == 6 else k): (k * 1000 + batch if k % 7 else None) for k in range(batch % 3, WORKERS, 3)}
    return last


def state(spark, path):
    return {r["worker_id"]: r["seen"] for r in stored_state(spark, path, ["worker_id"]).collect()}


def folders(path, name):
    return sorted(int(f.partition("=")[2]) for f in os.listdir(path) if f.startswith(name + "="))


def test_fifty_batches_leave_one_base_and_the_folders_since(spark, tmp_path):
    path = str(tmp_path / "state")
    for batch in range(BATCHES):
        change(spark, path, batch)
        if batch % 10 == 9:
            assert compact(spark, path, ["worker_id"]) == batch - 1
            assert state(spark, path) == newest(batch + 1)
    assert folders(path, tables.BATCH) == list(range(39, 50))
    assert folders(f"{path}/_base", "upto") == [38, 48]
    assert len(stored_state(spark, path, ["worker_id"]).inputFiles()) <= 2 + spark.sparkContext.defaultParallelism
    assert state(spark, path) == newest(BATCHES)

    change(spark, path, BATCHES - 1)
    assert state(spark, path) == newest(BATCHES)
    assert compact(spark, path, ["worker_id"]) == 48


def test_an_end_between_write_and_switch_is_made_good(spark, tmp_path):
    path = str(tmp_path / "state")
    for batch in range(4):
        change(spark, path, batch)
    spark.createDataFrame([(1, -1, 2)], "worker_id long, seen long, batch_id long").write.parquet(f"{path}/_base/upto=2")
    os.remove(f"{path}/_base/upto=2/_SUCCESS")
    assert state(spark, path) == newest(4)
    assert compact(spark, path, ["worker_id"]) == 2
    assert state(spark, path) == newest(4)


def test_an_unfinished_folder_does_not_count(spark, tmp_path):
    path = str(tmp_path / "state")
    for batch in range(3):
        change(spark, path, batch)
    os.remove(f"{path}/{tables.BATCH}=2/_SUCCESS")
    assert state(spark, path) == newest(2)
    assert compact(spark, path, ["worker_id"]) == 0


def test_no_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert compact(spark, path, ["worker_id"]) == -1
    with pytest.raises(FileNotFoundError):
        stored_state(spark, path, ["worker_id"])
    change(spark, path, 0)
    assert compact(spark, path, ["worker_id"]) == -1
    assert state(spark, path) == newest(1)
