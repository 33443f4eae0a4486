"""Sinks: tables and files, with batch sizes and codecs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codec names a user may give, as (name, Spark name), and the allowed batch sizes.
CODECS = {"none": "uncompressed", "": "uncompressed", "gzip": "gzip", "gz": "gzip", "lz4": "lz4", "zstd": "zstd"}
BATCH_SIZES = range(1, 10_001)
#: Spark's csv writer takes white space off both ends of a value unless told not to.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
SINK_FORMATS = ("parquet", "csv", "json", "text", "orc")


def codec(name: str) -> str:
    """Spark's name of a codec; an unknown one is an error."""
    if name not in CODECS:
        raise ValueError(f"unsupported compression {name!r}")
    return CODECS[name]


def write(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    mode: str = "append",
    batch_size: int | None = None,
    compression: str = "none",
    partition_by: Sequence[str] = (),
) -> None:
    """Write files. ``batch_size`` bounds the records of one file.

    With ``partition_by`` rows are rebalanced first: small folders get few files, a hot folder is split.
    """
    if file_format not in SINK_FORMATS:
        raise ValueError(f"unknown sink format {file_format!r}")
    if batch_size is not None and batch_size not in BATCH_SIZES:
        raise ValueError("batch size must be between 1 and 10000")
    name = codec(compression)
    if file_format in ("csv", "json", "text"):
        name = name.replace("uncompressed", "none")
    placed = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    writer = placed.write.format(file_format).mode(mode).option("compression", name)
    if batch_size is not None:
        writer = writer.option("maxRecordsPerFile", batch_size)
    if file_format == "csv":
        writer = writer.option("header", "true").option("escape", '"').options(**KEEP_SPACE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_table(df: DataFrame, name: str, mode: str = "append", **options) -> None:
    """Write a table of the catalog; the option ``path`` makes it external."""
    df.write.mode(mode).options(**options).saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str, driver: str, batch_size: int = 1000, mode: str = "append") -> None:
    """Insert into a database in batches; the JDBC driver must be on the class path of the session."""
    if batch_size not in BATCH_SIZES:
        raise ValueError("batch size must be between 1 and 10000")
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, driver=driver, batchsize=batch_size).save()


def log_lines(logs: DataFrame, file_format: str) -> DataFrame:
    """Log entries as one text line each: ``json``, ``text`` or ``csv``; any other format is an error.

    Expects timestamp, level, service, task_id, pipeline_id, node_id, message and context.
    """
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if file_format in ("json", ""):
        line = F.to_json(F.struct(stamp.alias("timestamp"), *[c for c in logs.columns if c != "timestamp"]))
    elif file_format == "text":
        line = F.format_string(
            "[%s] %s | %s | %s | %s", stamp, F.col("level"), F.col("service"), F.col("message"), F.coalesce("context", F.lit(""))
        )
    elif file_format == "csv":
        names = ("level", "service", "task_id", "pipeline_id", "node_id", "message")
        fields = [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]
        line = F.to_csv(F.struct(stamp.alias("timestamp"), *fields), {"escape": '"', "emptyValue": "", **KEEP_SPACE})
    else:
        raise ValueError(f"unknown log format {file_format!r}")
    return logs.select(line.alias("line"))


def export_logs(logs: DataFrame, path: str, file_format: str = "json") -> None:
    """Write logs as files; the csv form has a header per file and quotes where needed."""
    if file_format == "csv":
        names = ("timestamp", "level", "service", "task_id", "pipeline_id", "node_id", "message")
        write(logs.select(*names), path, "csv")
    else:
        log_lines(logs, file_format).write.mode("append").text(path)
