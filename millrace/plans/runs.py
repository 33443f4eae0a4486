"""Queries over executions, tasks, pipelines, versions and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, ordering, runs
from millrace.plans.registry import query

AS_OF = "2002-01-01 00:00:00"


@query(
    "exec_metrics",
    f"""
    WITH c AS (
        SELECT execution_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
               count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
               count(*) FILTER (status IN ('running', 'scheduled')) AS running
        FROM tasks GROUP BY execution_id)
    SELECT e.id, e.status, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed,
           coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running,
           CAST(epoch_us(coalesce(e.end_time, TIMESTAMP '{AS_OF}')) - epoch_us(e.start_time) AS BIGINT) // 1000000
               AS duration_seconds,
           CASE WHEN coalesce(total, 0) > 0 THEN completed * 100 // total ELSE 0 END AS progress
    FROM executions e LEFT JOIN c ON e.id = c.execution_id""",
)
def exec_metrics(t):
    return runs.execution_metrics(t.executions, t.tasks, AS_OF)


@query(
    "exec_task_durations",
    """SELECT execution_id, task_id,
              coalesce((epoch_us(end_time) - epoch_us(start_time)) // 1000000, 0) AS duration_seconds
       FROM tasks""",
)
def exec_task_durations(t):
    return runs.task_durations(t.tasks)


@query(
    "exec_rollup",
    """
    WITH c AS (SELECT execution_id, bool_and(status IN ('completed', 'failed')) AS all_ended,
                      bool_or(status = 'failed') AS any_failed FROM tasks GROUP BY execution_id)
    SELECT e.id, e.status AS old_status,
           CASE WHEN NOT coalesce(all_ended, true) THEN e.status
                WHEN coalesce(any_failed, false) THEN 'failed' ELSE 'completed' END AS new_status
    FROM executions e LEFT JOIN c ON e.id = c.execution_id""",
)
def exec_rollup(t):
    return runs.execution_rollup(t.executions, t.tasks)


@query(
    "exec_with_tasks",
    """SELECT e.id, e.pipeline_id, e.status AS execution_status, e.created_at,
              k.task_id, k.node_id, k.status AS task_status
       FROM executions e LEFT JOIN tasks k ON e.id = k.execution_id""",
)
def exec_with_tasks(t):
    executions = t.executions.select("id", "pipeline_id", F.col("status").alias("execution_status"), "created_at")
    tasks = t.tasks.select("execution_id", "task_id", "node_id", F.col("status").alias("task_status"))
    return joins.with_children(executions, tasks, "id", "execution_id").drop("execution_id")


@query(
    "task_pipeline",
    """SELECT k.task_id, k.execution_id, e.pipeline_id, p.name AS pipeline_name, p.status AS pipeline_status
       FROM tasks k JOIN executions e ON k.execution_id = e.id JOIN pipelines p ON e.pipeline_id = p.id""",
)
def task_pipeline(t):
    return joins.lookup_chain(t.tasks.select("task_id", "execution_id"), t.executions, t.pipelines)


@query("count_by_status", "SELECT status, count(*) AS n FROM executions GROUP BY status")
def count_by_status(t):
    return runs.count_by(t.executions, "status")


@query("count_by_type", "SELECT type, count(*) AS n FROM functions GROUP BY type")
def count_by_type(t):
    return runs.count_by(t.functions, "type")


@query(
    "agg_outcome",
    """SELECT node_id, count(*) AS total, count(*) FILTER (status = 'completed') AS success,
              count(*) FILTER (status = 'failed') AS failed FROM tasks GROUP BY node_id""",
)
def agg_outcome(t):
    return runs.outcome_summary(t.tasks, "node_id")


@query("results_failed", "SELECT task_id, execution_id, node_id FROM tasks WHERE status = 'failed'")
def results_failed(t):
    return t.tasks.where(F.col("status") == "failed").select("task_id", "execution_id", "node_id")


@query("results_successful", "SELECT task_id, execution_id, node_id FROM tasks WHERE status = 'completed'")
def results_successful(t):
    return t.tasks.where(F.col("status") == "completed").select("task_id", "execution_id", "node_id")


@query(
    "dashboard",
    """SELECT (SELECT count(*) FROM pipelines) AS total_pipelines,
              (SELECT count(*) FROM pipelines WHERE status = 'active') AS active_pipelines,
              count(*) AS total_executions, count(*) FILTER (status = 'running') AS running_executions,
              round(count(*) FILTER (status = 'completed') / count(*) FILTER (end_time IS NOT NULL), 6) AS success_rate,
              round(avg((epoch_us(end_time) - epoch_us(start_time)) // 1000000), 6) AS mean_duration_seconds,
              count(*) FILTER (CAST(created_at AS DATE) = DATE '1997-05-28') AS executions_today
       FROM executions""",
)
def dashboard(t):
    return runs.dashboard(t.pipelines, t.executions, "1997-05-28")


@query(
    "dashboard_recent",
    "SELECT id, pipeline_id, status, created_at FROM executions ORDER BY created_at DESC, id DESC LIMIT 10",
)
def dashboard_recent(t):
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return ordering.page(t.executions.select("id", "pipeline_id", "status", "created_at"), newest, 0, 10)


@query(
    "exec_page",
    """SELECT id, pipeline_id, status, created_at FROM executions
       ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""",
)
def exec_page(t):
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return ordering.page(t.executions.select("id", "pipeline_id", "status", "created_at"), newest, 40, 20)


@query("exec_page_total", "SELECT count(*) AS total FROM executions")
def exec_page_total(t):
    return t.executions.agg(F.count(F.lit(1)).alias("total"))


@query(
    "pending_topk",
    """SELECT id, pipeline_id, created_at FROM executions WHERE status = 'pending'
       ORDER BY created_at, id LIMIT 25""",
)
def pending_topk(t):
    pending = t.executions.where(F.col("status") == "pending").select("id", "pipeline_id", "created_at")
    return pending.orderBy("created_at", "id").limit(25)


@query(
    "exec_listing",
    """SELECT pipeline_id, status, id, created_at FROM executions
       WHERE status <> 'pending' AND pipeline_id IN (SELECT id FROM pipelines WHERE status = 'active')""",
)
def exec_listing(t):
    wanted = t.pipelines.where(F.col("status") == "active").select(F.col("id").alias("pipeline_id"))
    started = t.executions.where(F.col("status") != "pending")
    return started.join(wanted, "pipeline_id", "left_semi").select("pipeline_id", "status", "id", "created_at")


@query(
    "functions_active",
    "SELECT id, name, version, type FROM functions WHERE status = 'active' AND type = 'ECONOMY' ORDER BY name, id",
)
def functions_active(t):
    wanted = (F.col("status") == "active") & (F.col("type") == "ECONOMY")
    return t.functions.where(wanted).select("id", "name", "version", "type").orderBy("name", "id")


@query(
    "keys_exist",
    """SELECT r.name, r.version, k.name IS NOT NULL AS found
       FROM (SELECT DISTINCT name, version + 1 AS version FROM functions) r
       LEFT JOIN (SELECT DISTINCT name, version FROM functions) k ON r.name = k.name AND r.version = k.version""",
)
def keys_exist(t):
    requested = t.functions.select("name", (F.col("version") + 1).alias("version")).distinct()
    return joins.existing_keys(t.functions, requested, ["name", "version"])


@query(
    "cascade_delete",
    """SELECT 'execution' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS key_sum FROM executions
       WHERE id NOT IN (SELECT id FROM executions WHERE status = 'failed')
       UNION ALL
       SELECT 'task', count(*), CAST(sum(execution_id) AS BIGINT) FROM tasks
       WHERE execution_id NOT IN (SELECT id FROM executions WHERE status = 'failed')""",
)
def cascade_delete(t):
    doomed = t.executions.where(F.col("status") == "failed").select("id")
    kept_runs = joins.without_keys(t.executions, doomed, "id", "id")
    kept_tasks = joins.without_keys(t.tasks, doomed, "execution_id", "id")
    return kept_runs.agg(
        F.lit("execution").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("key_sum")
    ).unionByName(
        kept_tasks.agg(F.lit("task").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("execution_id").alias("key_sum"))
    )


@query(
    "task_timeline",
    """
    WITH x AS (
        SELECT *, start_time - INTERVAL 1 HOUR AS created_at,
               CASE WHEN status = 'failed' THEN 'node ' || node_id || ' failed' ELSE '' END AS error_message
        FROM tasks)
    SELECT task_id, node_id, created_at AS "timestamp", 'INFO' AS level, 'Task created' AS message FROM x
    UNION ALL SELECT task_id, node_id, start_time, 'INFO', 'Task started' FROM x WHERE start_time IS NOT NULL
    UNION ALL SELECT task_id, node_id, end_time, CASE WHEN status = 'failed' THEN 'ERROR' ELSE 'INFO' END,
                     'Task completed' FROM x WHERE end_time IS NOT NULL
    UNION ALL SELECT task_id, node_id, created_at, 'ERROR', error_message FROM x WHERE error_message <> ''""",
)
def task_timeline(t):
    failed = F.format_string("node %d failed", "node_id")
    tasks = t.tasks.withColumn("created_at", F.col("start_time") - F.expr("INTERVAL 1 HOUR")).withColumn(
        "error_message", F.when(F.col("status") == "failed", failed).otherwise("")
    )
    return runs.task_timeline(tasks)


@query(
    "status_fold",
    """SELECT pipeline_id, arg_max(status, ("timestamp", event_seq)) AS status,
              max("timestamp") FILTER (status = 'active') AS start_time,
              max("timestamp") FILTER (status IN ('stopped', 'failed')) AS end_time,
              count(*) FILTER (status = 'failed') AS errors, count(*) AS updates
       FROM status_events GROUP BY pipeline_id""",
)
def status_fold(t):
    return runs.fold_status(t.status_events)


_FOLDED = """arg_max(CASE WHEN error IS NOT NULL THEN 'failed' ELSE status END, (ts, seq)) AS status,
              min(ts) FILTER (status IN ({starts})) AS start_time,
              max(ts) FILTER (status IN ('completed', 'failed', 'cancelled') OR error IS NOT NULL) AS end_time,
              arg_max(error, (ts, seq)) FILTER (error IS NOT NULL) AS error_message,
              count(*) FILTER (retry) AS retries, count(*) AS updates"""
_ENDS = ("completed", "failed", "cancelled")


def _event(df, key: str, time: str, number: int, status, error=None, retry=None):
    return df.select(
        key, F.col(time).alias("timestamp"), F.lit(number).alias("event_seq"), status.alias("status"),
        (F.lit(None).cast("string") if error is None else error).alias("error"), (F.lit(False) if retry is None else retry).alias("retry"),
    )


@query(
    "execution_fold",
    f"""WITH ev AS (SELECT id, start_time AS ts, 1 AS seq, CASE WHEN status = 'pending' THEN 'scheduled' ELSE 'running' END AS status,
                           NULL AS error, false AS retry FROM executions
                    UNION ALL SELECT id, end_time, 2, status, CASE WHEN status = 'failed' THEN 'execution failed' END, false
                    FROM executions WHERE end_time IS NOT NULL)
        SELECT id, {_FOLDED.format(starts="'running'")} FROM ev GROUP BY id""",
)
def execution_fold(t):
    begun = _event(t.executions, "id", "start_time", 1, F.when(F.col("status") == "pending", "scheduled").otherwise("running"))
    over = t.executions.where("end_time is not null")
    ended = _event(over, "id", "end_time", 2, F.col("status"), F.when(F.col("status") == "failed", "execution failed"))
    return runs.fold_events(begun.unionByName(ended), "id", ("running",), _ENDS)


@query(
    "task_fold",
    f"""WITH ev AS (SELECT task_id, start_time AS ts, 1 AS seq, 'scheduled' AS status, NULL AS error, false AS retry FROM tasks
                    UNION ALL SELECT task_id, start_time, 2, 'running', NULL, retry_count > 0 FROM tasks WHERE status <> 'pending'
                    UNION ALL SELECT task_id, end_time, 3, status, CASE WHEN status = 'failed' THEN 'task failed' END, false
                    FROM tasks WHERE end_time IS NOT NULL)
        SELECT task_id, {_FOLDED.format(starts="'scheduled', 'running'")} FROM ev GROUP BY task_id""",
)
def task_fold(t):
    tasks = t.tasks
    planned = _event(tasks, "task_id", "start_time", 1, F.lit("scheduled"))
    begun = _event(tasks.where("status <> 'pending'"), "task_id", "start_time", 2, F.lit("running"), retry=F.col("retry_count") > 0)
    ended = _event(
        tasks.where("end_time is not null"), "task_id", "end_time", 3, F.col("status"), F.when(F.col("status") == "failed", "task failed")
    )
    return runs.fold_events(planned.unionByName(begun).unionByName(ended), "task_id", ("scheduled", "running"), _ENDS)


@query(
    "status_transitions",
    """
    WITH x AS (SELECT pipeline_id, event_seq, status,
                      lag(status) OVER (PARTITION BY pipeline_id ORDER BY "timestamp", event_seq) AS previous
               FROM status_events)
    SELECT pipeline_id, event_seq, previous, status,
           coalesce(previous || '>' || status IN ('draft>active', 'stopped>active', 'active>stopped',
                    'paused>stopped', 'active>paused', 'paused>active'), status = 'draft') AS legal
    FROM x""",
)
def status_transitions(t):
    moved = ordering.with_previous(
        t.status_events, "status", ["timestamp", "event_seq"], ordering.time_slice("timestamp", "hour"), ["pipeline_id"]
    )
    legal = F.when(F.col("previous").isNull(), F.col("status") == "draft").otherwise(
        runs.legal_move(F.col("previous"), F.col("status"))
    )
    return moved.select("pipeline_id", "event_seq", "previous", "status", legal.alias("legal"))


VERSION_ORDER = ["created_at", "version_key"]


def version_rows(t):
    """Order history of a customer as unnumbered versions of a pipeline."""
    return t.orders.select(
        F.col("o_custkey").alias("pipeline_id"),
        F.col("o_orderkey").alias("version_key"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("definition"),
        F.col("o_orderpriority").alias("changelog"),
    )


def versions(t):
    order = [F.col(c) for c in VERSION_ORDER]
    return ordering.numbered(version_rows(t), order, ordering.time_slice("created_at", "week"), ["pipeline_id"], "version")


@query(
    "version_latest",
    """SELECT v.pipeline_id, v.version, v.version_key, v.changelog FROM pipeline_versions v
       QUALIFY row_number() OVER (PARTITION BY v.pipeline_id ORDER BY v.version DESC) = 1""",
)
def version_latest(t):
    newest = F.max(F.struct(*VERSION_ORDER, "changelog")).alias("newest")
    per_pipeline = version_rows(t).groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("version"), newest)
    return per_pipeline.select("pipeline_id", "version", "newest.version_key", "newest.changelog")


@query(
    "version_history",
    """SELECT pipeline_id, version, version_key, changelog,
              definition - lag(definition) OVER (PARTITION BY pipeline_id ORDER BY version) AS change
       FROM pipeline_versions ORDER BY pipeline_id, version DESC""",
)
def version_history(t):
    slices = ordering.time_slice("created_at", "week")
    history = ordering.with_previous(
        version_rows(t), "definition", VERSION_ORDER, slices, ["pipeline_id"], position="version"
    )
    change = F.col("definition") - F.col("previous")
    return history.select("pipeline_id", "version", "version_key", "changelog", change.alias("change")).orderBy(
        "pipeline_id", F.col("version").desc()
    )


@query(
    "version_lookup",
    "SELECT pipeline_id, version, version_key, changelog FROM pipeline_versions WHERE version = 3",
)
def version_lookup(t):
    return versions(t).where(F.col("version") == 3).select("pipeline_id", "version", "version_key", "changelog")


@query(
    "version_next",
    """
    WITH stored AS (SELECT o_custkey AS pipeline_id, count(*) AS newest FROM orders
                    WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT o.o_custkey AS pipeline_id, o.o_orderkey AS request_id,
           CAST(coalesce(s.newest, 0) + row_number() OVER
               (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS BIGINT) AS version
    FROM orders o LEFT JOIN stored s ON o.o_custkey = s.pipeline_id WHERE o.o_orderstatus <> 'F'""",
)
def version_next(t):
    orders = t.orders.select(F.col("o_custkey").alias("pipeline_id"), "o_orderkey", "o_orderdate", "o_orderstatus")
    done = F.col("o_orderstatus") == "F"
    stored = orders.where(done).groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("newest"))
    requests = ordering.numbered(
        orders.where(~done),
        [F.col("o_orderdate"), F.col("o_orderkey")],
        ordering.time_slice("o_orderdate", "week"),
        ["pipeline_id"],
    )
    version = (F.coalesce(F.col("newest"), F.lit(0)) + F.col("position")).cast("bigint")
    return requests.join(stored, "pipeline_id", "left").select(
        "pipeline_id", F.col("o_orderkey").alias("request_id"), version.alias("version")
    )


@query(
    "version_rollback",
    """
    WITH current_version AS (SELECT pipeline_id AS id, max(version) AS version,
                                    arg_max(definition, version) AS definition
                             FROM pipeline_versions GROUP BY pipeline_id),
    requests AS (SELECT c_custkey AS pipeline_id, CAST(c_nationkey AS BIGINT) AS version
                 FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT c.id, CASE WHEN v.version IS NOT NULL THEN v.definition ELSE c.definition END AS definition,
           CASE WHEN v.version IS NOT NULL THEN v.version ELSE c.version END AS version,
           CASE WHEN v.version IS NOT NULL THEN 'rolled_back' WHEN r.version IS NOT NULL THEN 'version_missing'
                ELSE 'unchanged' END AS outcome
    FROM current_version c LEFT JOIN requests r ON c.id = r.pipeline_id
    LEFT JOIN pipeline_versions v ON v.pipeline_id = r.pipeline_id AND v.version = r.version""",
)
def version_rollback(t):
    history = versions(t).select("pipeline_id", "version", "definition")
    current = history.groupBy(F.col("pipeline_id").alias("id")).agg(
        F.max_by("definition", "version").alias("definition"), F.max("version").alias("version")
    )
    requests = t.customer.where(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("pipeline_id"), F.col("c_nationkey").cast("bigint").alias("version")
    )
    return joins.rollback(current, requests, history)


@query(
    "upsert_partial",
    """
    WITH incoming AS (SELECT p_partkey + 500 AS id, CASE WHEN p_size % 2 = 0 THEN '' ELSE upper(p_name) END AS name,
                             CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS type FROM part)
    SELECT coalesce(f.id, i.id) AS id, coalesce(nullif(i.name, ''), f.name) AS name,
           coalesce(nullif(i.type, ''), f.type) AS type,
           CASE WHEN f.id IS NULL THEN 'created' WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM functions f FULL JOIN incoming i ON f.id = i.id""",
)
def upsert_partial(t):
    incoming = t.part.select(
        (F.col("p_partkey") + 500).alias("id"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.upper("p_name")).alias("name"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("type"),
    )
    return joins.upsert_partial(t.functions, incoming, "id", ["name", "type"])
