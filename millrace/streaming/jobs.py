"""Streaming forms of the batch operators.

Aggregations run in update mode with partial aggregation before the shuffle, so that one hot key does not
land in one task row by row; the changed states of each micro-batch are written, and the newest per key is
the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import documents, metrics, validation
from millrace.operators.runs import TERMINAL
from millrace.operators.validation import FieldRule, issues_text
from millrace.session import scratch
from millrace.streaming import tables

# Fixed value: how old data may be before it is ignored, where that is asked for.
IGNORE_OLDER = "12 hours"


def collect_logs(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append log entries to a table by day; an entry without a time gets the time of arrival."""
    stamped = stream.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.current_timestamp().cast("timestamp_ntz")))
    tables.append(stamped.withColumn("day", F.to_date("timestamp")), path, checkpoint, ["day"])


def tail_log_files(spark: SparkSession, glob: str, fields: dict[str, str], max_file_age: str | None = None) -> DataFrame:
    """Lines of log files as they appear, with the file they come from and static fields at the root.

    ``max_file_age`` lets a stream pass over files that much older than the newest; by default none is.
    """
    reader = spark.readStream.format("text")
    lines = (reader.option("maxFileAge", max_file_age) if max_file_age else reader).load(glob)
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        *[F.lit(v).alias(k) for k, v in fields.items()],
    )


def rollup_metrics(
    stream: DataFrame, labels: Sequence[str], path: str, checkpoint: str, width: str, delay: str
) -> None:
    """Windowed counts and sums per label tuple; expects ``metric``, ``timestamp`` and ``value``.

    Rows more than ``delay`` behind the newest are too late to count.
    """
    windows = metrics.windowed(tables.event_time(stream, "timestamp", delay), labels, width)
    tables.each_batch(windows, path, checkpoint, mode="update")


def track_liveness(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Last heartbeat per worker; how old it is gets decided when the table is read."""
    tables.each_batch(metrics.latest_beats(stream), path, checkpoint, mode="update")


def quarantine(stream: DataFrame, rules: Sequence[FieldRule], path: str, checkpoint: str) -> None:
    """Validate a stream and write each micro-batch once, split into ``side`` main and quarantine."""

    def split(batch: DataFrame) -> DataFrame:
        checked = validation.validate(batch, rules)
        side = F.when(F.col("valid"), "main").otherwise("quarantine")
        return checked.withColumn("error", issues_text(F.col("errors"))).withColumn("side", side).drop("errors", "valid")

    tables.each_batch(stream, path, checkpoint, split, partition_by=["side"])


def cut_late(stream: DataFrame, key: str, path: str, checkpoint: str, delay: str = IGNORE_OLDER) -> None:
    """Drop rows older than the watermark and repeated keys; state of a key ends with the watermark."""
    on_time = tables.event_time(stream, "timestamp", delay).dropDuplicatesWithinWatermark([key])
    tables.append(on_time, path, checkpoint)


def account_transfers(
    stream: DataFrame, payload: str, order_by: str, slice_by: Column, path: str, checkpoint: str, batch_size: int
) -> None:
    """Transfer batches of every micro-batch, the last one short."""
    tables.each_batch(
        stream, path, checkpoint, lambda batch: documents.batch_totals(batch, payload, order_by, slice_by, batch_size)
    )


def roll_up_executions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Tasks in total and by outcome per execution, and its status once all have ended."""
    ended = F.col("status").isin(*TERMINAL)
    counts = stream.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ended).alias("ended"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    status = F.when(F.col("ended") < F.col("total"), "running").when(F.col("failed") > 0, "failed").otherwise("completed")
    tables.each_batch(counts.withColumn("status", status), path, checkpoint, mode="update")


def track_sessions(stream: DataFrame, path: str, checkpoint: str, gap_seconds: int, delay: str) -> None:
    """Activity slots per worker; ``metrics.join_slots`` makes sessions of the table."""
    slots = metrics.activity_slots(tables.event_time(stream, "timestamp", delay), gap_seconds)
    tables.each_batch(slots, path, checkpoint, mode="update")


def run(job, stream: DataFrame, *args, **settings) -> DataFrame:
    """Run a job into fresh folders below the shared folder and read the table back."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "progress")
    job(stream, *args, path=path, checkpoint=checkpoint, **settings)
    return spark.read.parquet(path)
