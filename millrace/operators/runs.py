"""Analytics over pipeline executions and their tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states a run or task may be in.
TERMINAL = ("completed", "failed")
RUNNING = ("running", "scheduled")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(1_000_000)).cast("bigint")


def task_counts(tasks: DataFrame) -> DataFrame:
    """One row per execution: tasks in total and by state."""
    status = F.col("status")
    return tasks.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status.isin(*RUNNING)).alias("running"),
    )


def execution_metrics(executions: DataFrame, tasks: DataFrame, as_of: str) -> DataFrame:
    """Task counts, progress in percent and duration in seconds; open runs are measured to ``as_of``."""
    counts = task_counts(tasks)
    joined = executions.join(counts, executions["id"] == counts["execution_id"], "left")
    names = ["total", "completed", "failed", "pending", "running"]
    filled = [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    duration = seconds_between(
        F.col("start_time"), F.coalesce(F.col("end_time"), F.lit(as_of).cast("timestamp_ntz"))
    )
    progress = F.when(F.col("total") > 0, F.expr("completed * 100 div total")).otherwise(F.lit(0))
    return joined.select("id", "status", *filled, duration.alias("duration_seconds")).withColumn(
        "progress", progress.cast("bigint")
    )


def task_durations(tasks: DataFrame) -> DataFrame:
    """Seconds per task, 0 while it is unfinished; one row per task, not one map per execution."""
    duration = F.coalesce(seconds_between(F.col("start_time"), F.col("end_time")), F.lit(0))
    return tasks.select("execution_id", "task_id", duration.cast("bigint").alias("duration_seconds"))


def execution_rollup(executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Status of each execution once its tasks have all ended; others keep theirs."""
    ended = tasks.groupBy("execution_id").agg(
        F.bool_and(F.col("status").isin(*TERMINAL)).alias("all_ended"),
        F.bool_or(F.col("status") == "failed").alias("any_failed"),
    )
    all_ended = F.coalesce(F.col("all_ended"), F.lit(True))
    any_failed = F.coalesce(F.col("any_failed"), F.lit(False))
    rolled = F.when(~all_ended, F.col("status")).when(any_failed, "failed").otherwise("completed")
    return executions.join(ended, executions["id"] == ended["execution_id"], "left").select(
        "id", F.col("status").alias("old_status"), rolled.alias("new_status")
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def outcome_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Totals per group; pending and cancelled rows count only in the total."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def dashboard(pipelines: DataFrame, executions: DataFrame, today: str) -> DataFrame:
    """One row of platform totals, from one pass over each table."""
    ended = F.col("end_time").isNotNull()
    per_pipeline = pipelines.agg(
        F.count(F.lit(1)).alias("total_pipelines"),
        F.count_if(F.col("status") == "active").alias("active_pipelines"),
    )
    per_run = executions.agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(F.col("status") == "running").alias("running_executions"),
        F.round(F.count_if(F.col("status") == "completed") / F.count_if(ended), 6).alias("success_rate"),
        F.round(F.avg(F.when(ended, seconds_between(F.col("start_time"), F.col("end_time")))), 6).alias(
            "mean_duration_seconds"
        ),
        F.count_if(F.to_date("created_at") == F.lit(today).cast("date")).alias("executions_today"),
    )
    both = per_pipeline.unionByName(per_run, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def fold_status(events: DataFrame, key: str = "pipeline_id") -> DataFrame:
    """Current state of every entity from its status events ``(key, timestamp, event_seq, status)``."""
    status, ts = F.col("status"), F.col("timestamp")
    order = F.struct("timestamp", "event_seq")
    return events.groupBy(key).agg(
        F.max_by(status, order).alias("status"),
        F.max(F.when(status == "active", ts)).alias("start_time"),
        F.max(F.when(status.isin("stopped", "failed"), ts)).alias("end_time"),
        F.count_if(status == "failed").alias("errors"),
        F.count(F.lit(1)).alias("updates"),
    )


def fold_events(events: DataFrame, key: str, starts: tuple[str, ...], ends: tuple[str, ...]) -> DataFrame:
    """Current state of executions or tasks from their events ``(key, timestamp, event_seq, status, error, retry)``.

    The first state of ``starts`` sets the start, the last of ``ends`` the end; an event with an error fails the
    entity from then on and gives its message; retries are counted.
    """
    order = F.struct("timestamp", "event_seq")
    failed = F.col("error").isNotNull()
    state = F.when(failed, F.lit("failed")).otherwise(F.col("status"))
    return events.groupBy(key).agg(
        F.max_by(state, order).alias("status"),
        F.min(F.when(F.col("status").isin(*starts), F.col("timestamp"))).alias("start_time"),
        F.max(F.when(F.col("status").isin(*ends) | failed, F.col("timestamp"))).alias("end_time"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, order)).alias("error_message"),
        F.count_if("retry").alias("retries"),
        F.count(F.lit(1)).alias("updates"),
    )


# The lifecycle moves a pipeline may make, as (from, to).
LEGAL_MOVES = (
    ("draft", "active"),
    ("stopped", "active"),
    ("active", "stopped"),
    ("paused", "stopped"),
    ("active", "paused"),
    ("paused", "active"),
)


def legal_move(old: Column, new: Column) -> Column:
    allowed = [f"{a}>{b}" for a, b in LEGAL_MOVES]
    return F.concat_ws(">", old, new).isin(*allowed)


def task_timeline(tasks: DataFrame) -> DataFrame:
    """Each task as created, started, completed and error events.

    Expects ``created_at``, ``start_time``, ``end_time``, ``status`` and ``error_message``.
    """

    def event(ts: Column, level: Column, message: Column) -> Column:
        return F.struct(ts.alias("timestamp"), level.alias("level"), message.alias("message"))

    info, error = F.lit("INFO"), F.lit("ERROR")
    has_error = F.coalesce(F.col("error_message"), F.lit("")) != ""
    events = F.array(
        event(F.col("created_at"), info, F.lit("Task created")),
        event(F.col("start_time"), info, F.lit("Task started")),
        event(F.col("end_time"), F.when(F.col("status") == "failed", error).otherwise(info), F.lit("Task completed")),
        event(F.when(has_error, F.col("created_at")), error, F.col("error_message")),
    )
    return tasks.select("task_id", "node_id", F.explode(events).alias("e")).select(
        "task_id", "node_id", "e.*"
    ).where(F.col("timestamp").isNotNull())
