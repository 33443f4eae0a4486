"""Streams with state per key and timers in event time: completion of executions, workers that fall silent, late rows.

State ends: a key is forgotten when it is done, or when the watermark passes its patience. Rows of a key are put
together within every Arrow batch before they are shuffled, so that a hot key sends few rows to its one task. State
functions run once per bucket of keys, on arrays of all its keys, not once per key: a call costs as much as some
thousand rows. Rows without a key are ticks: they move event time on (the clock of an idle stream) and leave no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.runs import TERMINAL
from millrace.streaming import tables

# Fixed value: keys are dealt by hash into so many groups, each with one value of state. It is part of a checkpoint.
BUCKETS = 1 << 10
_LONG = np.dtype("int64")
_NEVER = np.iinfo(_LONG).min  # as a time: null

_PART = "execution_id bigint, expected bigint, ended bigint, failed bigint, timestamp timestamp"
_DONE = "execution_id bigint, tasks bigint, failed bigint, ended_at timestamp, status string"


def _dealt(stream: DataFrame, key: str) -> DataFrame:
    """Add the key's bucket; rows without a key have one of their own, -1, so that they only move the watermark."""
    return stream.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int"))


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(_LONG)


def _times(micros: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(micros).view("datetime64[us]")


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(bytes(data), _LONG).reshape(-1, width)


def _arrived(parts: Iterator[pd.DataFrame], state: GroupState, width: int, columns) -> np.ndarray:
    """The rows of all parts as one matrix of longs."""
    found = [] if state.hasTimedOut else [np.column_stack([np.asarray(c).astype(_LONG) for c in columns(part)]) for part in parts]
    return np.concatenate([np.empty((0, width), _LONG), *found])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where each group of equal keys begins, in rows sorted by them."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        groups = batch.groupby("execution_id", as_index=False, dropna=False)
        yield groups.agg({"expected": "max", "ended": "sum", "failed": "sum", "timestamp": "max"})


def _heard(part: pd.DataFrame) -> list[np.ndarray]:
    ended, none = part["ended"].to_numpy(), np.zeros(len(part), _LONG)
    last = np.where(ended > 0, _micros(part["timestamp"]), 0)
    return [part["execution_id"], part["expected"].fillna(-1), ended, part["failed"], np.maximum(last, 0), none, none + 1]


def _completing(patience_ms: int):
    """State of a bucket: a row of longs for each execution: its id, expected, ended, failed, newest end, and when it is given up."""

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return
        now = state.getCurrentWatermarkMs()
        known = _matrix(state.get[0], 6) if state.exists else np.empty((0, 6), _LONG)
        rows = np.concatenate([np.column_stack([known, np.zeros(len(known), _LONG)]), _arrived(parts, state, 7, _heard)])
        if not len(rows):
            return
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = _firsts(rows[:, 0])
        expected, last, due, fresh = (np.maximum.reduceat(rows[:, k], at) for k in (1, 4, 5, 6))
        ended, failed = (np.add.reduceat(rows[:, k], at) for k in (2, 3))
        due = np.where(fresh > 0, np.maximum(last // 1000, now) + patience_ms, due)
        done = (expected >= 0) & (ended >= expected)
        over = done | (due < now)
        if over.any():
            status = np.where(done, np.where(failed > 0, "failed", "completed"), "timed_out")
            out = {"execution_id": rows[at, 0], "tasks": ended, "failed": failed, "ended_at": _times(last), "status": status.astype(object)}
            yield pd.DataFrame({name: column[over] for name, column in out.items()})
        left = np.column_stack([rows[at, 0], expected, ended, failed, last, due])[~over]
        if len(left):
            state.update((left.tobytes(),))
            state.setTimeoutTimestamp(int(left[:, 5].min()))
        elif state.exists:
            state.remove()

    return update


def complete_executions(
    executions: DataFrame, tasks: DataFrame, path: str, checkpoint: str, delay: str, patience_seconds: int
) -> dict | None:
    """One row per execution when its last task ends: ``execution_id``, ``tasks``, ``failed``, ``ended_at``, ``status``.

    ``executions`` tells how many tasks to expect (``execution_id``, ``expected``, ``timestamp``), ``tasks`` reports each
    task once when it has ended (``execution_id``, ``status``, ``timestamp``); either may come first. An execution is
    ``failed`` if one of its tasks is. One that hears nothing for ``patience_seconds`` of event time is given up as
    ``timed_out`` with what it has. In both cases its state ends. The watermark is the older of the two streams'. Returns the last progress.
    """
    started = executions.select(
        "execution_id", F.col("expected").cast("long").alias("expected"), F.lit(0).cast("long").alias("ended"),
        F.lit(0).cast("long").alias("failed"), F.col("timestamp").cast("timestamp").alias("timestamp"),
    )
    over = tasks.where(F.col("status").isin(*TERMINAL) | F.col("execution_id").isNull()).select(
        "execution_id", F.lit(None).cast("long").alias("expected"), F.lit(1).cast("long").alias("ended"),
        (F.col("status") == "failed").cast("long").alias("failed"), F.col("timestamp").cast("timestamp").alias("timestamp"),
    )
    started, over = (_dealt(s.mapInPandas(_put_together, _PART), "execution_id").withWatermark("timestamp", delay) for s in (started, over))
    done = started.union(over).groupBy("bucket").applyInPandasWithState(
        _completing(patience_seconds * 1000), _DONE, "executions binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return tables.each_batch(done, path, checkpoint)


# ---- workers that fall silent

_SLOT = "worker_id bigint, slot bigint, first bigint, last bigint, timestamp timestamp"
_SILENT = "worker_id bigint, went_at timestamp, back_at timestamp"
_WATCH = "workers binary, slots binary"


def _slots(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["timestamp"].astype("datetime64[us]").astype("int64")
            beats = pd.DataFrame({"worker_id": batch["worker_id"], "slot": at // width, "first": at, "last": at, "timestamp": batch["timestamp"]})
            groups = beats.groupby(["worker_id", "slot"], as_index=False, dropna=False)
            yield groups.agg({"first": "min", "last": "max", "timestamp": "max"})

    return run


def _seen(part: pd.DataFrame) -> list[np.ndarray]:
    return [part["worker_id"], part["slot"], part["first"], part["last"]]


def _watching(silence: int, forget: int):
    """Times are microseconds. Beats of a slot as long as ``silence`` can't be too far apart, so a slot keeps its first
    and last beat. A slot is judged when the watermark has passed it, as no beat can be added to it any more.

    State of a bucket: rows of longs for its workers (id, last beat judged or -1, told, when to look again in
    milliseconds) and for their slots to come (worker, slot, first, last). Only workers that were heard of, or whose
    time to look again has come, are looked at.
    """

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return
        now = state.getCurrentWatermarkMs() * 1000
        workers, slots = (_matrix(data, 4) for data in state.get) if state.exists else (np.empty((0, 4), _LONG),) * 2
        heard = _arrived(parts, state, 4, _seen)
        begun = np.setdiff1d(heard[:, 0], workers[:, 0])
        begun = np.column_stack([begun, np.full_like(begun, -1), np.zeros_like(begun), np.zeros_like(begun)])
        workers = np.concatenate([workers, begun])
        if not len(workers):
            return
        workers = workers[np.argsort(workers[:, 0])]
        who, last, told, due = workers.T.copy()
        active = np.isin(who, heard[:, 0]) | (due < now // 1000)
        slots = np.concatenate([slots, heard])
        slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
        if len(slots):
            at = _firsts(slots[:, 0], slots[:, 1])
            slots = np.column_stack([slots[at, :2], np.minimum.reduceat(slots[:, 2], at), np.maximum.reduceat(slots[:, 3], at)])
        owner = np.searchsorted(who, slots[:, 0])
        ripe = active[owner] & ((slots[:, 1] + 1) * silence <= now)
        # Slots that are over, in order: each against the end of the one before, a worker's first against what is known.
        of, first, end = owner[ripe], slots[ripe, 2], slots[ripe, 3]
        opens = np.zeros(len(of), bool)
        opens[_firsts(of)] = True
        before = np.where(opens, last[of], np.maximum(last[of], np.roll(end, 1)))
        back = np.where(first - before <= forget, first, _NEVER)
        away = (before >= 0) & (first - before > silence) & ((back != _NEVER) | ~opens | (told[of] == 0))
        np.maximum.at(last, of, end)
        told[of] = 0
        slots, owner = slots[~ripe], owner[~ripe]
        nearest = _firsts(owner)
        ahead, turn = np.full((2, len(who)), np.iinfo(_LONG).max)
        ahead[owner[nearest]], turn[owner[nearest]] = slots[nearest, 2], (slots[nearest, 1] + 1) * silence
        silent = active & (last >= 0) & (told == 0) & (last + silence < now) & (ahead - last > silence)
        told[silent] = 1
        if away.any() or silent.any():
            went = np.concatenate([before[away], last[silent]]) + silence
            backs = np.concatenate([back[away], np.full(silent.sum(), _NEVER)])
            yield pd.DataFrame({"worker_id": np.concatenate([who[of[away]], who[silent]]), "went_at": _times(went), "back_at": _times(backs)})
        waits = np.zeros(len(who), bool)
        waits[owner] = True
        gone = active & ~waits & ((last < 0) | (told > 0) & (last + forget < now))
        again = np.minimum(turn, np.where(last < 0, turn, last + np.where(told > 0, forget, silence)))
        due = np.where(active, np.maximum(again // 1000, now // 1000) + 1, due)
        if gone.all():
            if state.exists:
                state.remove()
            return
        state.update((np.column_stack([who, last, told, due])[~gone].tobytes(), slots.tobytes()))
        state.setTimeoutTimestamp(int(due[~gone].min()))

    return update


def watch_silence(stream: DataFrame, path: str, checkpoint: str, delay: str, silence_seconds: int, forget_seconds: int) -> dict | None:
    """Workers without a heartbeat for more than ``silence_seconds``: ``worker_id``, ``went_at``, ``back_at``.

    A row is written when the watermark shows the silence, and again with ``back_at`` when the worker is heard of; the
    newest row per (worker_id, went_at) is the result (``tables.newest_state``). After ``forget_seconds`` (longer than
    the silence) a silent worker is forgotten, and its return begins anew. Expects ``worker_id`` and ``timestamp``.
    """
    if forget_seconds <= silence_seconds:
        raise ValueError("a worker can only be forgotten after it has been silent")
    beats = stream.select(F.col("worker_id").cast("long").alias("worker_id"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    silence = silence_seconds * 1_000_000
    slots = _dealt(beats.mapInPandas(_slots(silence), _SLOT), "worker_id").withWatermark("timestamp", delay)
    silent = slots.groupBy("bucket").applyInPandasWithState(
        _watching(silence, forget_seconds * 1_000_000), _SILENT, _WATCH, "append", GroupStateTimeout.EventTimeTimeout
    )
    return tables.each_batch(silent, path, checkpoint)


# ---- late rows

ON_TIME, LATE, CLOCK = "on_time", "late", "clock"


def count_with_late(stream: DataFrame, labels, path: str, checkpoint: str, width_seconds: int, delay_seconds: int) -> None:
    """Windowed counts per label tuple that lose nothing: rows of windows that have closed go to a side table.

    Below ``path`` every micro-batch writes its part of ``on_time`` (``metric``, labels, ``window_start``, ``n``,
    ``total``, to be added up over batches by ``counted``), of ``late`` (whole rows) and its newest event time in
    ``clock``. The watermark of a batch is the newest time of earlier batches less ``delay_seconds``; a row is late if
    its window ended at or before it. A batch that is run again finds the same watermark and replaces its folders.
    Expects ``metric``, ``timestamp`` and ``value``.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.col("timestamp").cast("timestamp")
        start = F.timestamp_seconds(F.floor(F.unix_seconds(at) / width_seconds) * width_seconds)
        watermark = None
        if batch_id > 0:
            clock = spark.read.schema(f"newest timestamp, {tables.BATCH} long").parquet(f"{path}/{CLOCK}")
            newest = clock.where(F.col(tables.BATCH) < batch_id).agg(F.max("newest")).first()[0]
            watermark = F.lit(newest) - F.make_interval(secs=F.lit(delay_seconds)) if newest is not None else None
        rows = batch.withColumn("window_start", start).persist()
        end = F.col("window_start") + F.make_interval(secs=F.lit(width_seconds))
        late = F.coalesce(end <= watermark, F.lit(False)) if watermark is not None else F.lit(False)
        part = rows.where(~late).groupBy("metric", *labels, "window_start").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
        part.write.mode("overwrite").parquet(f"{path}/{ON_TIME}/{tables.BATCH}={batch_id}")
        rows.where(late).write.mode("overwrite").parquet(f"{path}/{LATE}/{tables.BATCH}={batch_id}")
        rows.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{path}/{CLOCK}/{tables.BATCH}={batch_id}")
        rows.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()


def counted(parts: DataFrame, labels) -> DataFrame:
    """The counts of all micro-batches together."""
    return parts.groupBy("metric", *labels, "window_start").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
