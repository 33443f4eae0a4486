"""JSON text to typed records. Text that does not parse is flagged, never lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Schemas of the JSON documents the platform exchanges.
DEFINITION = """
    nodes ARRAY<STRUCT<id STRING, name STRING, type STRING, function STRING, config MAP<STRING, STRING>,
                       depends_on ARRAY<STRING>>>,
    edges ARRAY<STRUCT<`from` STRING, `to` STRING>>,
    execution STRUCT<parallelism INT, retryPolicy STRUCT<maxRetries INT, backoff STRING>>"""
DEAD_LETTER = """
    id STRING, payload STRING, metadata MAP<STRING, STRING>, error STRING, timestamp TIMESTAMP,
    retry_count INT, source STRING"""
FILE_CONTENT = """
    path STRING, name STRING, size BIGINT, content STRING, metadata MAP<STRING, STRING>, mod_time TIMESTAMP,
    checksum STRING, format STRING, compressed BOOLEAN"""
DATA_RECORD = """
    id STRING, name STRING, data_type STRING, value STRING, metadata MAP<STRING, STRING>,
    created_at TIMESTAMP, updated_at TIMESTAMP"""

CORRUPT = "_corrupt"


def ingest(df: DataFrame, column: str, schema: str, out: str = "record") -> DataFrame:
    """Parse ``column`` into a struct and a ``malformed`` flag; a malformed text gives a null struct."""
    full = StructType.fromDDL(schema).add(CORRUPT, StringType())
    parsed = df.withColumn("__parsed", F.from_json(column, full, {"columnNameOfCorruptRecord": CORRUPT}))
    malformed = F.coalesce(F.col("__parsed")[CORRUPT].isNotNull(), F.lit(False)) | (
        F.col("__parsed").isNull() & F.col(column).isNotNull()
    )
    names = [F.col("__parsed")[n].alias(n) for n in StructType.fromDDL(schema).names]
    return (
        parsed.withColumn("malformed", malformed)
        .withColumn(out, F.when(~F.col("malformed") & F.col("__parsed").isNotNull(), F.struct(*names)))
        .drop("__parsed")
    )
