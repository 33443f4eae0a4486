"""Quarantine tables: failing records kept as messages in named queues.

A message is ``(queue, id, payload, source, error, timestamp, enqueued_at, retry_count)``: ``timestamp`` is the
last change, ``enqueued_at`` the place in the queue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.sources.sinks import write

# Default capacity of a queue, share that counts as nearly full, days a message is kept,
# listing size and preview length.
CAPACITY = 10_000
NEAR_PERCENT = 80.0
RETENTION_DAYS = 7
LIST_LIMIT = 100
PREVIEW_LENGTH = 100


def to_messages(bad: DataFrame, key: str, queue: Column, source: Column, error: Column, timestamp: Column) -> DataFrame:
    """Failing rows as messages with the row as JSON payload."""
    return bad.select(
        queue.alias("queue"),
        F.col(key).alias("id"),
        F.to_json(F.struct(*bad.columns)).alias("payload"),
        source.alias("source"),
        error.alias("error"),
        timestamp.alias("timestamp"),
        timestamp.alias("enqueued_at"),
        F.lit(0).alias("retry_count"),
    )


def admit(
    messages: DataFrame,
    slice_by: Column,
    existing: DataFrame | None = None,
    capacity: int = CAPACITY,
    order_by: Sequence[str] = ("enqueued_at", "id"),
) -> DataFrame:
    """Flag which messages fit: the rest are kept with ``accepted`` false, never dropped.

    ``existing(queue, size)`` gives what the queues already hold.
    """
    placed = ordering.numbered(messages, [F.col(c) for c in order_by], slice_by, ["queue"])
    if existing is None:
        return placed.withColumn("accepted", F.col("position") <= capacity)
    sizes = existing.select("queue", F.col("size").alias("__size"))
    held = F.coalesce("__size", F.lit(0))
    return (
        placed.join(sizes, "queue", "left")
        .withColumn("position", F.col("position") + held)
        .withColumn("accepted", F.col("position") <= capacity)
        .drop("__size")
    )


def store(messages: DataFrame, path: str) -> None:
    """Append messages to a quarantine table, one folder per day."""
    write(messages.withColumn("day", F.to_date("timestamp")), path, partition_by=["day"])


def requeue(messages: DataFrame, requested: DataFrame, now: str) -> DataFrame:
    """Count a retry, reset the time and clear the error of the requested ids; they keep their place."""
    asked = requested.select("id").distinct().withColumn("__asked", F.lit(True))
    hit = F.coalesce(F.col("__asked"), F.lit(False))
    return (
        messages.join(asked, "id", "left")
        .withColumns(
            {
                "retry_count": F.col("retry_count") + hit.cast("int"),
                "timestamp": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("timestamp")),
                "error": F.when(~hit, F.col("error")),
            }
        )
        .drop("__asked")
    )


def unknown_ids(messages: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids that no queue holds."""
    return requested.select("id").distinct().join(messages.select("id"), "id", "left_anti")


def remove(messages: DataFrame, requested: DataFrame) -> DataFrame:
    return messages.join(requested.select("id").distinct(), "id", "left_anti")


def clear(messages: DataFrame, queues: DataFrame) -> DataFrame:
    """Empty the named queues."""
    return messages.join(queues.select("queue").distinct(), "queue", "left_anti")


def peek(messages: DataFrame, offset: int = 0, limit: int = LIST_LIMIT) -> DataFrame:
    """Oldest messages first; a bad offset reads as 0, a limit below 1 is an error."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    offset = max(offset, 0)
    ordered = messages.orderBy("enqueued_at", "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def stats(messages: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    usage = F.col("size") / F.lit(capacity) * 100
    return (
        messages.groupBy("queue")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("usage_percent", usage)
        .withColumn("near_capacity", F.col("usage_percent") > NEAR_PERCENT)
        .withColumn("full", F.col("size") >= capacity)
    )


def preview(messages: DataFrame, length: int = PREVIEW_LENGTH) -> DataFrame:
    """Id, start of the payload and error as one line. The cut is by character, so text stays valid."""
    start = F.when(
        F.char_length("payload") > length, F.concat(F.substring("payload", 1, length), F.lit("..."))
    ).otherwise(F.col("payload"))
    line = F.concat(F.lit("ID: "), F.col("id"), F.lit(", Payload: "), start, F.lit(", Error: "), F.col("error"))
    return messages.select("id", line.alias("line"))


def retained(messages: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Messages young enough to keep; of a stored table older folders are not read."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    kept = messages.where(F.col("timestamp") >= oldest)
    return kept.where(F.col("day") >= F.to_date(oldest)) if "day" in messages.columns else kept
