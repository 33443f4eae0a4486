"""Error codes, retry decisions, backoff and retry accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The error codes in number order, starting at 0, and the two classes of codes.
CODES = (
    "UNKNOWN",
    "INVALID_PARAMETER", "MISSING_PARAMETER", "INVALID_CONFIGURATION", "CONFIGURATION_NOT_FOUND",
    "PIPELINE_NOT_FOUND", "PIPELINE_ALREADY_EXISTS", "PIPELINE_RUNNING", "PIPELINE_STOPPED",
    "PIPELINE_COMPLETED", "PIPELINE_FAILED", "PIPELINE_TIMEOUT",
    "NODE_NOT_FOUND", "NODE_ALREADY_EXISTS", "NODE_NOT_READY", "NODE_PROCESSING", "NODE_FAILED", "NODE_TIMEOUT",
    "TASK_NOT_FOUND", "TASK_ALREADY_EXISTS", "TASK_PENDING", "TASK_RUNNING", "TASK_COMPLETED", "TASK_FAILED",
    "TASK_CANCELLED", "TASK_TIMEOUT", "TASK_RETRY_EXHAUSTED",
    "WORKER_NOT_FOUND", "WORKER_ALREADY_EXISTS", "WORKER_NOT_AVAILABLE", "WORKER_HEARTBEAT_TIMEOUT",
    "WORKER_CAPACITY_EXCEEDED",
    "DATABASE_ERROR", "DATABASE_CONNECTION_FAILED", "DATABASE_QUERY_FAILED", "DATABASE_TRANSACTION_FAILED",
    "DATABASE_DUPLICATE_ENTRY", "DATABASE_NOT_FOUND",
    "REDIS_ERROR", "REDIS_CONNECTION_FAILED", "REDIS_OPERATION_FAILED", "REDIS_TIMEOUT",
    "NETWORK_ERROR", "CONNECTION_REFUSED", "CONNECTION_TIMEOUT", "REQUEST_TIMEOUT",
    "UNAUTHORIZED", "FORBIDDEN", "NOT_FOUND", "CONFLICT", "INTERNAL_SERVER_ERROR", "SERVICE_UNAVAILABLE",
    "GATEWAY_TIMEOUT",
    "VALIDATION_FAILED", "SERIALIZATION_FAILED", "DESERIALIZATION_FAILED",
    "FILE_NOT_FOUND", "FILE_READ_FAILED", "FILE_WRITE_FAILED", "FILE_PERMISSION_DENIED",
    "RESOURCE_NOT_FOUND", "RESOURCE_ALREADY_EXISTS", "RESOURCE_EXHAUSTED", "RESOURCE_BUSY",
    "OPERATION_CANCELLED", "OPERATION_TIMEOUT", "OPERATION_NOT_SUPPORTED",
    "SYSTEM_ERROR", "OUT_OF_MEMORY", "OUT_OF_DISK_SPACE", "OUT_OF_CAPACITY",
)
RETRYABLE = (
    "DATABASE_CONNECTION_FAILED", "DATABASE_QUERY_FAILED", "REDIS_CONNECTION_FAILED", "REDIS_OPERATION_FAILED",
    "NETWORK_ERROR", "CONNECTION_REFUSED", "CONNECTION_TIMEOUT", "REQUEST_TIMEOUT", "RESOURCE_BUSY",
    "SERVICE_UNAVAILABLE",
)
FATAL = (
    "UNAUTHORIZED", "FORBIDDEN", "INVALID_PARAMETER", "MISSING_PARAMETER", "INVALID_CONFIGURATION",
    "VALIDATION_FAILED", "SERIALIZATION_FAILED", "DESERIALIZATION_FAILED", "FILE_PERMISSION_DENIED",
)


def code_name(number: Column) -> Column:
    """Name of a code number; numbers outside the list read as unknown."""
    names = F.array(*[F.lit(c) for c in CODES])
    return F.coalesce(F.get(names, number.cast("int")), F.lit("UNKNOWN"))


def code_class(name: Column) -> Column:
    return F.when(name.isin(*RETRYABLE), "retryable").when(name.isin(*FATAL), "fatal").otherwise("other")


def should_retry(attempt: Column, code: Column, max_attempts: int) -> Column:
    """Retry unless attempts ran out or the code is fatal; without an error the answer is yes.

    A maximum of 0 or less means no limit.
    """
    left = attempt < max_attempts if max_attempts > 0 else F.lit(True)
    return F.when(code.isNull(), F.lit(True)).otherwise(left & ~code.isin(*FATAL))


def backoff_delay(
    attempt: Column,
    policy: str = "exponential",
    initial_ms: int = 100,
    step_ms: float | None = None,
    multiplier: float = 2.0,
    max_ms: int = 60_000,
) -> Column:
    """Wait before an attempt in milliseconds; an unknown policy is exponential.

    The linear step is the first wait times the multiplier, if not given.
    """
    n = F.greatest(attempt, F.lit(1)) - F.lit(1)
    if policy == "fixed":
        return F.lit(initial_ms).cast("bigint")
    if policy == "linear":
        delay = F.lit(initial_ms) + F.lit(initial_ms * multiplier if step_ms is None else step_ms) * n
    else:
        delay = F.lit(float(initial_ms)) * F.pow(F.lit(multiplier), n)
    return F.least(delay.cast("double"), F.lit(float(max_ms))).cast("bigint")


def total_backoff(attempt: Column, policy: str = "exponential", **settings) -> Column:
    """Waits of attempts 1..n added up, computed in the row instead of over a window."""
    steps = F.sequence(F.lit(1), F.greatest(attempt, F.lit(1)).cast("int"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, n: total + backoff_delay(n, policy, **settings))


def retry_stats(attempts: DataFrame, key: str) -> DataFrame:
    """Attempts, total time and last attempt per key; an open attempt counts no time.

    ``attempts(key, attempt, start_time, end_time)``.
    """
    micros = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    return attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(F.coalesce((micros / F.lit(1000)).cast("bigint"), F.lit(0))).alias("total_ms"),
        F.max("attempt").alias("last_attempt"),
        F.max_by("start_time", F.struct("attempt", "start_time")).alias("last_start"),
    )


def error_summary(errors: DataFrame, group: str, wanted: str, order_by: list[str]) -> DataFrame:
    """Size of each error group, whether it holds a code, and its first error; ``errors(group, code, …)``."""
    return errors.groupBy(group).agg(
        F.count(F.lit(1)).alias("errors"),
        F.bool_or(F.col("code") == wanted).alias("has_code"),
        F.min_by("code", F.struct(*order_by)).alias("first_error"),
    )
