"""Streaming queries: each reads a whole table as a stream and returns the table the job wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics, ordering
from millrace.operators.validation import FieldRule
from millrace.plans.observability import LATEST
from millrace.plans.registry import query
from millrace.plans.views import TASK_COLUMNS
from millrace.session import scratch
from millrace.sources import sinks
from millrace.streaming import compaction, jobs, stateful, tables


def stream_of(t, name: str):
    """A supplied table as a stream. The pattern names the table whether it is one file or a folder of files;
    a stream source takes a plain path only for folders."""
    return tables.stream_source(t.spark, f"{t.sf_dir}/{name}.parque[t]", t.read(name).schema)


def log_stream(t):
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARN")
        .when(F.col("event_type") == "purchase", "INFO")
        .otherwise("DEBUG")
    )
    return stream_of(t, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"), level.alias("level"), F.col("event_type").alias("service")
    )


def beat_stream(t):
    return stream_of(t, "events").select(
        F.col("event_id").alias("beat_id"),
        F.col("user_id").alias("worker_id"),
        F.col("ts").alias("timestamp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tasks_running"),
        F.when(F.col("event_type") == "error", "lost").otherwise("running").alias("status"),
    )


@query("stream_source", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def stream_source(t):
    orders = stream_of(t, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return jobs.run(tables.append, orders)


@query("stream_logs", 'SELECT log_id, "timestamp", level, service, CAST("timestamp" AS DATE) AS day FROM logs')
def stream_logs(t):
    return jobs.run(jobs.collect_logs, log_stream(t))


@query(
    "stream_log_files",
    """SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || level || '|' || service AS line, 'platform' AS app, true AS has_file
       FROM logs""",
)
def stream_log_files(t):
    folder = scratch(t.spark, "logs")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    sinks.write(t.logs.select(F.concat_ws("|", stamp, "level", "service").alias("value")), folder, "text")
    lines = jobs.tail_log_files(t.spark, f"{folder}/*.txt", {"app": "platform"})
    return jobs.run(tables.append, lines).select("line", "app", (F.length("file") > 0).alias("has_file"))


@query(
    "stream_metrics",
    """SELECT time_bucket(INTERVAL 10 SECOND, "timestamp") AS window_start, metric, label_type, count(*) AS n,
              CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, max(value) AS peak
       FROM metric_samples GROUP BY ALL""",
)
def stream_metrics(t):
    samples = stream_of(t, "events").select(
        F.lit("duration_ms").alias("metric"), F.col("event_type").alias("label_type"), F.col("ts").alias("timestamp"), "value"
    )
    states = jobs.run(jobs.rollup_metrics, samples, ["label_type"], width="10 seconds", delay="40 days")
    newest = tables.newest_state(states, ["window_start", "metric", "label_type"])
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_liveness",
    f"""WITH b AS (SELECT * FROM heartbeats
                   QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY "timestamp" DESC, beat_id DESC) = 1)
        SELECT worker_id, CASE WHEN epoch_us(TIMESTAMP '{LATEST}') - epoch_us("timestamp") > 43200000000
                                 OR status IN ('inactive', 'lost') THEN 0 ELSE 1 END AS alive, tasks_running,
               (epoch_us(TIMESTAMP '{LATEST}') - epoch_us("timestamp")) / 1000000 AS age_seconds
        FROM b""",
)
def stream_liveness(t):
    states = jobs.run(jobs.track_liveness, beat_stream(t))
    return metrics.liveness(tables.newest_state(states, ["worker_id"]), LATEST, offline_seconds=43_200)


@query(
    "stream_liveness_compacted",
    """SELECT worker_id, arg_max("timestamp", ("timestamp", beat_id)) AS "timestamp", arg_max(status, ("timestamp", beat_id)) AS status
       FROM heartbeats GROUP BY worker_id""",
)
def stream_liveness_compacted(t):
    """Last beats from six micro-batches, the first five of them folded into a base."""
    beats = tables.sliced(t.heartbeats, "timestamp", scratch(t.spark, "beats"), 6)
    path, checkpoint = scratch(t.spark, "stream"), scratch(t.spark, "progress")
    jobs.track_liveness(beats, path, checkpoint)
    compaction.compact(t.spark, path, ["worker_id"])
    return compaction.stored_state(t.spark, path, ["worker_id"]).select("worker_id", "timestamp", "status")


@query(
    "stream_dlq",
    """SELECT doc_id, CASE WHEN strlen(text) < 200 OR lang NOT IN ('de', 'en') THEN 'quarantine' ELSE 'main' END AS side,
              concat_ws('; ', CASE WHEN strlen(text) < 200 THEN 'text: length must be at least 200' END,
                        CASE WHEN lang NOT IN ('de', 'en') THEN 'lang: value must be one of [de en]' END) AS error
       FROM documents""",
)
def stream_dlq(t):
    rules = [FieldRule("text", required=True, min_length=200), FieldRule("lang", enum=("de", "en"))]
    written = jobs.run(jobs.quarantine, stream_of(t, "documents"), rules)
    return written.select("doc_id", "side", "error")


@query("stream_late", 'SELECT log_id, "timestamp", level, service FROM logs')
def stream_late(t):
    kept = jobs.run(jobs.cut_late, log_stream(t), "log_id")
    return kept.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "stream_transfer",
    """WITH n AS (SELECT strlen(props) AS size, row_number() OVER (ORDER BY event_id) AS position FROM events)
       SELECT (position - 1) // 1024 AS batch, count(*) AS records, CAST(sum(size) + 8 AS BIGINT) AS bytes FROM n GROUP BY 1""",
)
def stream_transfer(t):
    sent = jobs.run(
        jobs.account_transfers,
        stream_of(t, "events"),
        "props",
        "event_id",
        ordering.id_slice("event_id"),
        batch_size=1024,
    )
    return sent.select("batch", "records", "bytes")


@query(
    "stream_rollup",
    """SELECT execution_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed')) AS ended,
              count(*) FILTER (status = 'failed') AS failed,
              CASE WHEN NOT bool_and(status IN ('completed', 'failed')) THEN 'running'
                   WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS status
       FROM tasks GROUP BY execution_id""",
)
def stream_rollup(t):
    tasks = stream_of(t, "lineitem").select(*TASK_COLUMNS())
    states = jobs.run(jobs.roll_up_executions, tasks.select("execution_id", "status"))
    return tables.newest_state(states, ["execution_id"])


@query(
    "stream_sessions",
    """WITH x AS (SELECT worker_id, "timestamp" AS ts,
                         coalesce(epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER
                             (PARTITION BY worker_id ORDER BY "timestamp", beat_id) > 14400000000, true) AS opens
                  FROM heartbeats),
            y AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER
                      (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x)
       SELECT worker_id, CAST(session AS BIGINT) AS session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS beats
       FROM y GROUP BY worker_id, session""",
)
def stream_sessions(t):
    states = jobs.run(jobs.track_sessions, beat_stream(t), gap_seconds=14_400, delay="40 days")
    sessions = metrics.join_slots(tables.newest_state(states, ["worker_id", "slot"]), 14_400)
    return sessions.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


DAY = 86_400


@query(
    "stream_completion",
    """SELECT execution_id, count(*) AS tasks, count(*) FILTER (status = 'failed') AS failed, max(end_time) AS ended_at,
              CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS status
       FROM tasks GROUP BY execution_id HAVING bool_and(status IN ('completed', 'failed'))""",
)
def stream_completion(t):
    """Executions and tasks arrive as two streams in spans of time; those whose tasks never all end time out."""
    tasks = t.tasks.where("end_time is not null").select("execution_id", "status", F.col("end_time").alias("timestamp"))
    expected = t.tasks.groupBy("execution_id").agg(F.count("*").alias("expected"), F.min("start_time").alias("timestamp"))
    counted = scratch(t.spark, "expected")
    expected.write.parquet(counted)  # counted once, not for every span
    expected = t.spark.read.schema(expected.schema).parquet(counted)
    started = tables.sliced(expected, "timestamp", scratch(t.spark, "started"), 3, tick=8000 * DAY)
    ended = tables.sliced(tasks, "timestamp", scratch(t.spark, "ended"), 3, tick=8000 * DAY)
    done = jobs.run(lambda s, **to: stateful.complete_executions(s, ended, **to), started, delay="1000 days", patience_seconds=3000 * DAY)
    done = done.where("status <> 'timed_out'").withColumn("ended_at", F.col("ended_at").cast("timestamp_ntz"))
    return done.select("execution_id", "tasks", "failed", "ended_at", "status")


@query(
    "stream_offline",
    """WITH b AS (SELECT worker_id, "timestamp" AS ts, lead("timestamp") OVER (PARTITION BY worker_id ORDER BY "timestamp") AS following FROM heartbeats)
       SELECT worker_id, ts + INTERVAL 12 HOUR AS went_at, CASE WHEN following <= ts + INTERVAL 60 HOUR THEN following END AS back_at
       FROM b WHERE following IS NULL OR following > ts + INTERVAL 12 HOUR""",
)
def stream_offline(t):
    """Heartbeats in spans of time, then a tick of the clock: who fell silent for twelve hours, and when they came back."""
    beats = tables.sliced(t.heartbeats.select("worker_id", "timestamp"), "timestamp", scratch(t.spark, "beats"), 3, tick=100 * DAY)
    told = jobs.run(stateful.watch_silence, beats, delay="12 days", silence_seconds=DAY // 2, forget_seconds=5 * DAY // 2)
    newest = tables.newest_state(told, ["worker_id", "went_at"])
    return newest.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("went_at", "back_at")})


_LATE_SQL = """
WITH s AS (SELECT *, CASE WHEN sample_id % 3 = 0 THEN 2 ELSE CAST(floor(2 * (epoch("timestamp") - min(epoch("timestamp")) OVER ()) / (1 + max(epoch("timestamp")) OVER () - min(epoch("timestamp")) OVER ())) AS INTEGER) END AS batch
           FROM metric_samples),
w AS (SELECT b.batch, max(s."timestamp") - INTERVAL 1 DAY AS watermark FROM (VALUES (1), (2)) b(batch) JOIN s ON s.batch < b.batch GROUP BY b.batch),
x AS (SELECT s.*, time_bucket(INTERVAL 1 HOUR, s."timestamp") AS window_start FROM s),
y AS (SELECT x.*, coalesce(x.window_start + INTERVAL 1 HOUR <= w.watermark, false) AS late FROM x LEFT JOIN w USING (batch))
SELECT label_type, count(*) AS n, count(*) FILTER (NOT late) AS counted, count(*) FILTER (late) AS late,
       count(DISTINCT window_start) FILTER (NOT late) AS windows
FROM y GROUP BY label_type"""


@query("stream_metrics_late", _LATE_SQL)
def stream_metrics_late(t):
    """Three micro-batches; a third of the samples comes in the last one, most of them too late."""
    samples = t.metric_samples.select("sample_id", "metric", "label_type", "timestamp", "value")
    seconds = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    low, high = samples.agg(F.min(seconds), F.max(seconds)).first()
    turn = F.when(F.col("sample_id") % 3 == 0, 2).otherwise(F.floor(2 * (seconds - low) / (1 + high - low)))
    folder = scratch(t.spark, "samples")
    for k in range(3):
        samples.where(turn == k).coalesce(1).write.mode("append").parquet(folder)
    stream = tables.stream_source(t.spark, folder, samples.schema, files_per_batch=1)
    path, checkpoint = scratch(t.spark, "stream"), scratch(t.spark, "progress")
    stateful.count_with_late(stream, ["label_type"], path, checkpoint, width_seconds=3600, delay_seconds=DAY)
    counted = stateful.counted(t.spark.read.parquet(f"{path}/{stateful.ON_TIME}"), ["label_type"])
    late = t.spark.read.parquet(f"{path}/{stateful.LATE}").groupBy("label_type").agg(F.count("*").alias("late"))
    kept = counted.groupBy("label_type").agg(F.sum("n").alias("counted"), F.count("*").alias("windows"))
    both = kept.join(late, "label_type", "full").na.fill(0, ["counted", "late", "windows"])
    return both.select("label_type", (F.col("counted") + F.col("late")).alias("n"), "counted", "late", "windows")
