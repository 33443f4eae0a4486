"""Stream sources and sinks on files in the shared folder.

Every job runs with ``availableNow``: it takes what has arrived, in as many micro-batches as the source is
told to make, and stops. A checkpoint folder makes the next run go on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "batch_id"

# Fixed value: rows a file of a sliced table holds at most, about.
ROWS_A_FILE = 1 << 19


def stream_source(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
    **options,
) -> DataFrame:
    """Stream of the files at a path, a folder or a glob."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Cast to the type watermarks need and set the watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def append(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Run a stream into a parquet table, exactly once."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def each_batch(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    mode: str = "append",
    partition_by: Sequence[str] = (),
) -> dict | None:
    """Write each micro-batch to a folder of its own; a batch that is run again replaces its folder.

    Returns the progress of the last micro-batch, which tells the size of the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = transform(batch).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(write).start()
    query.awaitTermination()
    return query.lastProgress


def newest_state(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of each key in the last micro-batch that changed it."""
    rest = [c for c in table.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*rest), F.col(BATCH)).alias("__state")
    return table.groupBy(*keys).agg(newest).select(*keys, "__state.*")


def sliced(rows: DataFrame, time: str, path: str, slices: int, tick: float | None = None) -> DataFrame:
    """Write ``rows`` to a folder in ``slices`` equal spans of ``time``, the oldest first, and read it as a stream of
    that order. With ``tick`` a last file has one row of nulls whose time is that many seconds after the newest.

    A micro-batch takes one span, however large: all spans are dealt out evenly over as many files as the largest needs
    (``ROWS_A_FILE``), and so many files are read at a time. A span with fewer rows than files shares its micro-batch
    with the next. Rows of a span may come in any order, so a watermark's delay must be at least a span for none to be late.
    """
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    files = 1
    if low is not None:
        width = (high - low) // slices + 1
        spans = [(at >= low + k * width) & (at < low + (k + 1) * width) for k in range(slices)]
        files = -(-max(rows.agg(*[F.count_if(span) for span in spans]).first()) // ROWS_A_FILE)
        for span in spans:
            rows.where(span).repartition(files).write.mode("append").parquet(path)
        if tick is not None:
            spark = rows.sparkSession
            end = F.timestamp_seconds(F.lit(high + tick)).cast(rows.schema[time].dataType)
            nulls = [end.alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
            spark.range(1).select(*nulls).write.mode("append").parquet(path)
    else:
        rows.write.mode("append").parquet(path)
    return stream_source(rows.sparkSession, path, rows.schema, files_per_batch=files)
