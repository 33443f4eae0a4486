"""Queries over logs, metrics and heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import logs, metrics, ordering, rollover
from millrace.plans.registry import query
from millrace.session import scratch
from millrace.sources import sinks, tables

LATEST = "2024-01-30 23:59:59"


@query(
    "log_query",
    """SELECT * FROM (SELECT log_id, "timestamp", level, service, pipeline_id, message FROM logs
                      WHERE level = 'ERROR' AND service = 'error'
                        AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND contains(message, '7')
                      ORDER BY log_id DESC LIMIT 100) ORDER BY log_id""",
)
def log_query(t):
    return logs.search(
        t.logs.select("log_id", "timestamp", "level", "service", "pipeline_id", "message"),
        start="2024-01-05",
        end="2024-01-25",
        contains="7",
        last=100,
        level="ERROR",
        service="error",
        node_id=None,
    )


@query(
    "log_search_stored",
    """SELECT log_id, "timestamp", level, service, pipeline_id, message FROM logs
       WHERE pipeline_id BETWEEN 10 AND 10 AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:30:00'""",
)
def log_search_stored(t):
    """A log table laid out for skipping, then a search by pipeline and time."""
    path = scratch(t.spark, "logs")
    logs.store(t.logs, path, ["pipeline_id", "log_id"])
    stored = t.spark.read.parquet(path)
    return logs.search(stored, start="2024-01-05", end="2024-01-25 12:30:00", pipeline_id=10).select(
        "log_id", "timestamp", "level", "service", "pipeline_id", "message"
    )


@query(
    "metric_quantile_rollup",
    """SELECT label_type, CAST("timestamp" AS DATE) AS day, q.quantile, count(*) AS n, true AS near
       FROM metric_samples, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) q(quantile) GROUP BY ALL""",
)
def metric_quantile_rollup(t):
    """A day's quantiles from hourly sketches, and whether their ranks among the samples are as near as promised."""
    hourly = metrics.sketched(t.metric_samples, ["label_type"], "1 hour")
    day = F.to_date("window_start").alias("day")
    found = metrics.merged_quantiles(hourly, ["label_type", day], [0.5, 0.95])
    samples = t.metric_samples.select("label_type", F.to_date("timestamp").alias("day"), F.col("value").alias("sample"))
    ranked = samples.join(found, ["label_type", "day"]).groupBy("label_type", "day", "quantile", "n").agg(
        F.count_if(F.col("sample") < F.col("value")).alias("below"), F.count_if(F.col("sample") <= F.col("value")).alias("upto")
    )
    slack = F.col("n") * 0.01 + 1
    near = (F.col("below") <= F.col("quantile") * F.col("n") + slack) & (F.col("upto") >= F.col("quantile") * F.col("n") - slack)
    return ranked.select("label_type", "day", "quantile", "n", near.alias("near"))


@query("log_level_threshold", "SELECT log_id, level FROM logs WHERE level IN ('WARN', 'ERROR', 'FATAL')")
def log_level_threshold(t):
    spelled = t.logs.withColumn("level_text", F.when(F.col("level") == "WARN", "warning").otherwise(F.lower("level")))
    return logs.at_least(spelled, "WARNING", "level_text").select("log_id", "level")


@query(
    "log_export_text",
    """SELECT '[' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || '] ' || level || ' | ' || service || ' | ' || message
              || ' | {"node":"' || node_id || '"}' AS line FROM logs""",
)
def log_export_text(t):
    context = F.to_json(F.create_map(F.lit("node"), F.col("node_id").cast("string")))
    return sinks.log_lines(t.logs.withColumn("context", context), "text")


@query(
    "log_export_csv",
    """SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || ',' || level || ',' || service || ',' || log_id || ','
              || pipeline_id || ',' || node_id || ',"' || replace(message, '"', '""') || '"' AS line FROM logs""",
)
def log_export_csv(t):
    return sinks.log_lines(t.logs.withColumn("task_id", F.col("log_id")), "csv")


@query(
    "log_export_json",
    """SELECT '{"timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' || level || '","service":"'
              || service || '"}' AS line FROM logs""",
)
def log_export_json(t):
    return sinks.log_lines(t.logs.select("timestamp", "level", "service"), "json")


@query("datasource_scan", """SELECT log_id AS task_id, "timestamp", level, service, message FROM logs WHERE level <> 'DEBUG'""")
def datasource_scan(t):
    """Exported lines read back by a table source of user code, in ranges of 256 kB."""
    path = scratch(t.spark, "lines")
    names = ["timestamp", "level", "service", F.col("log_id").alias("task_id"), "pipeline_id", "node_id", "message"]
    sinks.export_logs(t.logs.select(*names), path)
    tables.register(t.spark)
    wanted = "task_id string, timestamp timestamp_ntz, level string, service string, message string"
    back = t.spark.read.format(tables.FORMAT).option("rangeBytes", 256 << 10).schema(wanted).load(path)
    return back.where("level <> 'DEBUG'").withColumn("task_id", F.col("task_id").cast("bigint"))


@query(
    "log_facets",
    """SELECT pipeline_id, node_id, service, level, count(*) AS entries FROM logs
       GROUP BY GROUPING SETS ((pipeline_id), (node_id), (service), (level))""",
)
def log_facets(t):
    return logs.facets(t.logs, ["pipeline_id", "node_id", "service", "level"])


@query(
    "log_retain_last",
    'SELECT log_id, "timestamp", service FROM logs ORDER BY "timestamp" DESC, log_id DESC LIMIT 5000',
)
def log_retain_last(t):
    newest = [F.col("timestamp").desc(), F.col("log_id").desc()]
    return ordering.keep_newest(t.logs.select("log_id", "timestamp", "service"), 5000, newest)


@query(
    "log_retain_service",
    """SELECT log_id, "timestamp", service FROM logs
       QUALIFY row_number() OVER (PARTITION BY service ORDER BY "timestamp" DESC, log_id DESC) <= 200""",
)
def log_retain_service(t):
    newest = [F.col("timestamp").desc(), F.col("log_id").desc()]
    entries = t.logs.select("log_id", "timestamp", "service")
    return ordering.keep_newest(entries, 200, newest, ["service"], ordering.time_slice("timestamp", "minute"))


@query(
    "log_retention",
    """SELECT log_id, "timestamp", CAST("timestamp" AS DATE) AS day FROM logs
       WHERE "timestamp" >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY""",
)
def log_retention(t):
    return logs.retained(t.logs.select("log_id", "timestamp"), "2024-02-10", 30)


@query(
    "log_rollover",
    """WITH RECURSIVE r AS (
           SELECT CAST("timestamp" AS DATE) AS day, "timestamp" AS ts, log_id, strlen(message) + 1 AS size,
                  CAST(sum(strlen(message) + 1) OVER w AS BIGINT) - strlen(message) - 1 AS before, row_number() OVER w AS place
           FROM logs WINDOW w AS (PARTITION BY CAST("timestamp" AS DATE) ORDER BY "timestamp", log_id)),
       s AS (SELECT day, before AS opened FROM r WHERE place = 1
             UNION ALL
             SELECT s.day, min(r.before) FROM s JOIN r ON r.day = s.day AND r.before >= s.opened + 500 GROUP BY s.day),
       g AS (SELECT day, opened, lead(opened) OVER w AS closed, row_number() OVER w AS segment
             FROM s WINDOW w AS (PARTITION BY day ORDER BY opened))
       SELECT g.day, g.segment, arg_min(ts, place) AS first_timestamp, arg_min(log_id, place) AS first_log_id,
              arg_max(ts, place) AS last_timestamp, arg_max(log_id, place) AS last_log_id, count(*) AS entries,
              CAST(sum(size) AS BIGINT) AS bytes
       FROM g JOIN r ON r.day = g.day AND r.before >= g.opened AND (g.closed IS NULL OR r.before < g.closed)
       GROUP BY g.day, g.segment""",
)
def log_rollover(t):
    """Segments of a day or of 500 bytes, a line feed counted with every message."""
    size = F.octet_length("message") + 1
    return rollover.rollover(t.logs, 500, size, ["timestamp", "log_id"], ordering.time_slice("timestamp"))


@query(
    "worker_liveness",
    f"""WITH b AS (SELECT * FROM heartbeats
                   QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY "timestamp" DESC, beat_id DESC) = 1)
        SELECT worker_id, CASE WHEN epoch_us(TIMESTAMP '{LATEST}') - epoch_us("timestamp") > 43200000000
                                 OR status IN ('inactive', 'lost') THEN 0 ELSE 1 END AS alive, tasks_running,
               (epoch_us(TIMESTAMP '{LATEST}') - epoch_us("timestamp")) / 1000000 AS age_seconds
        FROM b""",
)
def worker_liveness(t):
    """Heartbeats here are hours apart, so half a day of silence counts as lost."""
    return metrics.liveness(t.heartbeats, LATEST, offline_seconds=43_200)


@query(
    "workers_available",
    """WITH b AS (SELECT * FROM heartbeats
                  QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY "timestamp" DESC, beat_id DESC) = 1)
       SELECT worker_id, "timestamp", beat_id, status, tasks_running FROM b WHERE status = 'running' AND tasks_running < 60""",
)
def workers_available(t):
    return metrics.available(t.heartbeats, "running", load_limit=60)


@query(
    "metric_counter",
    """SELECT metric, label_type, label_user, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS value, count(*) AS increments
       FROM metric_samples GROUP BY ALL""",
)
def metric_counter(t):
    return metrics.counter(t.metric_samples, ["label_type", "label_user"])


_OP = "CASE sample_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'dec' ELSE 'inc' END"


@query(
    "metric_gauge",
    f"""WITH s AS (SELECT *, {_OP} AS op FROM metric_samples),
             l AS (SELECT metric, label_user, max(sample_id) AS at, arg_max(value, sample_id) AS base
                   FROM s WHERE op = 'set' GROUP BY metric, label_user),
             d AS (SELECT s.metric, s.label_user,
                          sum(CAST(CASE WHEN op = 'dec' THEN -value ELSE value END AS DECIMAL(28, 6)))
                              FILTER (l.at IS NULL OR s.sample_id > l.at) AS delta
                   FROM s LEFT JOIN l USING (metric, label_user) WHERE op <> 'set' GROUP BY s.metric, s.label_user)
        SELECT coalesce(l.metric, d.metric) AS metric, coalesce(l.label_user, d.label_user) AS label_user,
               coalesce(base, 0) + coalesce(CAST(delta AS DOUBLE), 0) AS value
        FROM l FULL JOIN d ON l.metric = d.metric AND l.label_user = d.label_user""",
)
def metric_gauge(t):
    turn = F.col("sample_id") % 5
    samples = t.metric_samples.withColumn("op", F.when(turn == 0, "set").when(turn == 1, "dec").otherwise("inc"))
    return metrics.gauge(samples, ["label_user"], ["timestamp", "sample_id"], ordering.time_slice("timestamp", "day"))


_LE = ", ".join(f"({b})" for b in metrics.PIPELINE_BOUNDS)


@query(
    "metric_histogram",
    f"""WITH b(le) AS (VALUES {_LE}),
             n AS (SELECT metric, label_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total
                   FROM metric_samples GROUP BY ALL)
        SELECT n.metric, n.label_type, n.n, n.total, CAST(b.le AS DOUBLE) AS le,
               count(*) FILTER (s.value <= CAST(b.le AS DOUBLE)) AS bucket
        FROM n CROSS JOIN b JOIN metric_samples s ON s.metric = n.metric AND s.label_type = n.label_type
        GROUP BY ALL""",
)
def metric_histogram(t):
    return metrics.histogram(t.metric_samples, ["label_type"], metrics.PIPELINE_BOUNDS)


@query(
    "metric_summary",
    """SELECT metric, label_type, q.q AS quantile,
              round(CASE q.q WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.9 THEN quantile_cont(value, 0.9)
                       ELSE quantile_cont(value, 0.99) END, 6) AS value
       FROM metric_samples CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) q(q)
       GROUP BY metric, label_type, q.q""",
)
def metric_summary(t):
    exact = metrics.summary(t.metric_samples, ["label_type"], [0.5, 0.9, 0.99], slice_width=5.0)
    return exact.withColumn("value", F.round("value", 6))


@query(
    "run_metric_families",
    """WITH c AS (SELECT pipeline_id, status, CAST(count(*) AS DOUBLE) AS value FROM executions GROUP BY ALL)
       SELECT 'pipeline_count' AS metric, * FROM c
       UNION ALL SELECT 'pipeline_' || status, * FROM c WHERE status IN ('running', 'completed', 'failed')""",
)
def run_metric_families(t):
    return metrics.pipeline_families(t.executions)


@query(
    "run_duration_histogram",
    f"""WITH d AS (SELECT status, (epoch_us(coalesce(end_time, TIMESTAMP '2002-01-01')) - epoch_us(start_time)) / 1000000 AS seconds
                   FROM executions),
             b(le) AS (VALUES {_LE}),
             n AS (SELECT status, count(*) AS n, CAST(sum(CAST(seconds AS DECIMAL(28, 6))) AS DOUBLE) AS total FROM d GROUP BY status)
        SELECT 'pipeline_duration_seconds' AS metric, n.status, n.n, n.total, CAST(b.le AS DOUBLE) AS le,
               count(*) FILTER (d.seconds <= CAST(b.le AS DOUBLE)) AS bucket
        FROM n CROSS JOIN b JOIN d ON d.status = n.status GROUP BY ALL""",
)
def run_duration_histogram(t):
    as_of = F.lit("2002-01-01").cast("timestamp_ntz")
    seconds = dates.seconds_between(F.col("start_time"), F.coalesce("end_time", as_of))
    samples = t.executions.select(F.lit("pipeline_duration_seconds").alias("metric"), "status", seconds.alias("value"))
    return metrics.histogram(samples, ["status"], metrics.PIPELINE_BOUNDS)


@query(
    "metric_summary_approx",
    """SELECT metric, label_type, q.q AS quantile, count(value) AS n, true AS within
       FROM metric_samples CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) q(q)
       GROUP BY metric, label_type, q.q""",
)
def metric_summary_approx(t):
    """The sketched values depend on the partitions; that their ranks are as near as promised doesn't."""
    ranked = metrics.summary_accuracy(t.metric_samples, ["label_type"], [0.5, 0.9, 0.99])
    return ranked.select("metric", "label_type", "quantile", "n", "within")


@query(
    "function_rates_node",
    """SELECT f.type, e.pipeline_id, k.node_id, count(*) AS executions,
              count(*) FILTER (k.status = 'completed') / count(*) AS success_rate,
              count(*) FILTER (k.status = 'failed') / count(*) AS failure_rate,
              sum(epoch_us(k.end_time) - epoch_us(k.start_time)) / count(k.end_time) / 1000000 AS mean_seconds,
              CAST(sum(k.items) AS BIGINT) AS throughput
       FROM tasks k JOIN executions e ON k.execution_id = e.id JOIN functions f ON k.function_id = f.id
       GROUP BY f.type, e.pipeline_id, k.node_id""",
)
def function_rates_node(t):
    return metrics.function_rates(t.tasks, t.executions, t.functions, per_node=True)


@query(
    "function_rates",
    """SELECT f.type, e.pipeline_id, count(*) AS executions,
              count(*) FILTER (k.status = 'completed') / count(*) AS success_rate,
              count(*) FILTER (k.status = 'failed') / count(*) AS failure_rate,
              sum(epoch_us(k.end_time) - epoch_us(k.start_time)) / count(k.end_time) / 1000000 AS mean_seconds,
              CAST(sum(k.items) AS BIGINT) AS throughput
       FROM tasks k JOIN executions e ON k.execution_id = e.id JOIN functions f ON k.function_id = f.id
       GROUP BY f.type, e.pipeline_id""",
)
def function_rates(t):
    return metrics.function_rates(t.tasks, t.executions, t.functions)


@query(
    "metric_function_families",
    """WITH k AS (SELECT f.name AS function_name, e.pipeline_id, k.node_id, k.status, k.items,
                         epoch_us(k.end_time) - epoch_us(k.start_time) AS micros
                  FROM tasks k JOIN executions e ON k.execution_id = e.id JOIN functions f ON k.function_id = f.id),
            n AS (SELECT function_name, pipeline_id, node_id, count(*) AS n, sum(items) AS items FROM k GROUP BY ALL),
            p AS (SELECT function_name, pipeline_id, count(*) FILTER (status = 'completed') / count(*) AS good,
                         count(*) FILTER (status = 'failed') / count(*) AS bad, sum(micros) / count(micros) / 1000000 AS mean
                  FROM k GROUP BY ALL)
       SELECT 'function_execution_count' AS metric, function_name, pipeline_id, node_id, CAST(n AS DOUBLE) AS value FROM n
       UNION ALL SELECT 'function_throughput', function_name, pipeline_id, node_id, CAST(items AS DOUBLE) FROM n
       UNION ALL SELECT 'function_success_rate', function_name, pipeline_id, NULL, good FROM p
       UNION ALL SELECT 'function_failure_rate', function_name, pipeline_id, NULL, bad FROM p
       UNION ALL SELECT 'function_avg_duration_seconds', function_name, pipeline_id, NULL, mean FROM p WHERE mean IS NOT NULL""",
)
def metric_function_families(t):
    return metrics.function_families(t.tasks, t.executions, t.functions)


@query(
    "metric_node_families",
    """WITH n AS (SELECT k.node_id, e.pipeline_id, CAST(count(*) FILTER (k.status = 'running') AS DOUBLE) AS running
                  FROM tasks k JOIN executions e ON k.execution_id = e.id GROUP BY ALL)
       SELECT 'node_tasks_running' AS metric, node_id, pipeline_id, running AS value FROM n
       UNION ALL SELECT 'node_status', node_id, pipeline_id, CASE WHEN running > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n""",
)
def metric_node_families(t):
    return metrics.node_families(t.tasks, t.executions)


@query(
    "metric_window",
    """SELECT time_bucket(INTERVAL 10 SECOND, "timestamp") AS window_start, metric, label_type, count(*) AS n,
              CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, max(value) AS peak
       FROM metric_samples GROUP BY ALL""",
)
def metric_window(t):
    return metrics.windowed(t.metric_samples, ["label_type"], "10 seconds")


@query(
    "metric_window_sliding",
    """SELECT time_bucket(INTERVAL 30 MINUTE, "timestamp") - INTERVAL (o.o * 30) MINUTE AS window_start, metric, label_type,
              count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, max(value) AS peak
       FROM metric_samples CROSS JOIN (VALUES (0), (1)) o(o) GROUP BY ALL""",
)
def metric_window_sliding(t):
    return metrics.windowed(t.metric_samples, ["label_type"], "1 hour", "30 minutes")


@query(
    "activity_sessions",
    """WITH x AS (SELECT worker_id, "timestamp" AS ts,
                         coalesce(epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER
                             (PARTITION BY worker_id ORDER BY "timestamp", beat_id) > 14400000000, true) AS opens
                  FROM heartbeats),
            y AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER
                      (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x)
       SELECT worker_id, CAST(session AS BIGINT) AS session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS beats
       FROM y GROUP BY worker_id, session""",
)
def activity_sessions(t):
    return metrics.activity_sessions(t.heartbeats, gap_seconds=14_400)


_B = ", ".join(f"({b})" for b in metrics.DATABASE_BOUNDS)
_M1, _M2 = "'events_total'", "'event_seconds'"


@query(
    "metrics_lines",
    f"""WITH c AS (SELECT label_type AS t, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total
                   FROM metric_samples GROUP BY 1),
             b(le) AS (VALUES {_B}),
             h AS (SELECT label_type AS t, CAST(le AS DOUBLE) AS le, count(*) FILTER (value <= CAST(le AS DOUBLE)) AS bucket
                   FROM metric_samples CROSS JOIN b GROUP BY 1, 2)
        SELECT {_M1} AS metric, '0' AS ord, '# HELP events_total Samples' AS line
        UNION ALL SELECT {_M1}, '1', '# TYPE events_total counter'
        UNION ALL SELECT {_M1}, '2/' || t, 'events_total{{kind="' || t || '"}} ' || printf('%f', total) FROM c
        UNION ALL SELECT {_M2}, '0', '# HELP event_seconds Samples'
        UNION ALL SELECT {_M2}, '1', '# TYPE event_seconds histogram'
        UNION ALL SELECT {_M2}, '2/' || t || '/sum', 'event_seconds_sum{{kind="' || t || '"}} ' || printf('%f', total) FROM c
        UNION ALL SELECT {_M2}, '2/' || t || '/count', 'event_seconds_count{{kind="' || t || '"}} ' || n FROM c
        UNION ALL SELECT {_M2}, '2/' || t || '/bucket/' || lpad(printf('%f', le), 20, '0'),
                         'event_seconds_bucket{{kind="' || t || '",le="' || printf('%f', le) || '"}} ' || bucket FROM h""",
)
def metrics_lines(t):
    samples = t.metric_samples.withColumnRenamed("label_type", "kind")
    counters = metrics.counter(samples.withColumn("metric", F.lit("events_total")), ["kind"])
    histograms = metrics.histogram(samples.withColumn("metric", F.lit("event_seconds")), ["kind"], metrics.DATABASE_BOUNDS)
    return metrics.exposition(["kind"], "Samples", counters, histograms=histograms)


@query(
    "metrics_lines_gauges",
    f"""WITH s AS (SELECT *, {_OP} AS op FROM metric_samples),
             l AS (SELECT label_type AS t, label_user AS u, max(sample_id) AS at, arg_max(value, sample_id) AS base
                   FROM s WHERE op = 'set' GROUP BY 1, 2),
             d AS (SELECT label_type AS t, label_user AS u,
                          sum(CAST(CASE WHEN op = 'dec' THEN -value ELSE value END AS DECIMAL(28, 6)))
                              FILTER (l.at IS NULL OR s.sample_id > l.at) AS delta
                   FROM s LEFT JOIN l ON s.label_type = l.t AND s.label_user = l.u WHERE op <> 'set' GROUP BY 1, 2),
             g AS (SELECT coalesce(l.t, d.t) AS t, coalesce(l.u, d.u) AS u,
                          coalesce(base, 0) + coalesce(CAST(delta AS DOUBLE), 0) AS value
                   FROM l FULL JOIN d ON l.t = d.t AND l.u = d.u)
        SELECT 'node_status' AS metric, '0' AS ord, '# HELP node_status Node status (1=active, 0=inactive)' AS line
        UNION ALL SELECT 'node_status', '1', '# TYPE node_status gauge'
        UNION ALL SELECT 'node_status', '2/' || t || '\\"/' || u,
                         'node_status{{kind="' || t || '\\"",user="' || u || '"}} ' || printf('%f', value) FROM g""",
)
def metrics_lines_gauges(t):
    """Gauges of two labels, one of which needs escaping."""
    turn = F.col("sample_id") % 5
    samples = t.metric_samples.select(
        F.lit("node_status").alias("metric"),
        F.concat("label_type", F.lit('"')).alias("kind"),
        F.col("label_user").alias("user"),
        "timestamp",
        "sample_id",
        "value",
        F.when(turn == 0, "set").when(turn == 1, "dec").otherwise("inc").alias("op"),
    )
    day = ordering.time_slice("timestamp", "day")
    gauges = metrics.gauge(samples, ["kind", "user"], ["timestamp", "sample_id"], day)
    return metrics.exposition(["kind", "user"], "Samples", gauges=gauges)
