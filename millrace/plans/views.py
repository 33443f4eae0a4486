"""Stand-in views: pipeline runs, logs, files and records read from the supplied tables.

Every view exists twice, as a DataFrame here and as SQL text in ``SQL_VIEWS``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        """One DataFrame per table, so that files are listed and their schema is read once per query."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def executions(self) -> DataFrame:
        return self.read("orders").select(*EXECUTION_COLUMNS())

    @cached_property
    def tasks(self) -> DataFrame:
        return self.read("lineitem").select(*TASK_COLUMNS())

    @cached_property
    def pipelines(self) -> DataFrame:
        status = (
            F.when(F.col("c_mktsegment") == "BUILDING", "draft")
            .when(F.col("c_mktsegment") == "MACHINERY", "paused")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "stopped")
            .otherwise("active")
        )
        return self.read("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            status.alias("status"),
            F.col("c_acctbal").alias("budget"),
        )

    @cached_property
    def functions(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_size").alias("version"),
            F.col("p_type").alias("type"),
            F.when(F.col("p_size") <= 25, "active").otherwise("inactive").alias("status"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        level = (
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "signup", "WARN")
            .when(F.col("event_type") == "purchase", "INFO")
            .otherwise("DEBUG")
        )
        return self.read("events").select(
            F.col("event_id").alias("log_id"),
            F.col("ts").alias("timestamp"),
            level.alias("level"),
            F.col("event_type").alias("service"),
            F.col("user_id").alias("pipeline_id"),
            (F.col("user_id") % 8).alias("node_id"),
            F.col("props").alias("message"),
            F.col("value").alias("duration_ms"),
        )

    @cached_property
    def heartbeats(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("beat_id"),
            F.col("user_id").alias("worker_id"),
            F.col("ts").alias("timestamp"),
            F.get_json_object("props", "$.k").cast("bigint").alias("tasks_running"),
            F.when(F.col("event_type") == "error", "lost").otherwise("running").alias("status"),
        )

    @cached_property
    def metric_samples(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("sample_id"),
            F.lit("duration_ms").alias("metric"),
            F.col("event_type").alias("label_type"),
            F.col("user_id").alias("label_user"),
            F.col("ts").alias("timestamp"),
            F.col("value"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "view", "draft")
            .when(F.col("event_type") == "click", "active")
            .when(F.col("event_type") == "signup", "paused")
            .when(F.col("event_type") == "purchase", "stopped")
            .otherwise("failed")
        )
        return self.read("events").select(
            F.col("event_id").alias("event_seq"),
            F.col("user_id").alias("pipeline_id"),
            F.col("ts").alias("timestamp"),
            status.alias("status"),
        )

    @cached_property
    def page_files(self) -> DataFrame:
        return self.read("pages").select(
            F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.col("html").alias("content")
        )

    @cached_property
    def document_files(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("file_id"),
            F.format_string("%s/%d.md", "source", "doc_id").alias("path"),
            F.col("source").alias("parent"),
            F.col("text").alias("content"),
        )

    @cached_property
    def records(self) -> DataFrame:
        documents = self.read("documents").select("doc_id", "text", "lang", "source")
        return documents.join(self.read("labels"), "doc_id", "left")

    @cached_property
    def dead_letters(self) -> DataFrame:
        short = (F.octet_length("text") < 200).alias("short")  # before the join, so that texts move only if asked for
        documents = self.read("documents").select("doc_id", "source", "text", short)
        broken = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.col("short")
        stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).cast("timestamp_ntz")
        return documents.join(self.read("labels"), "doc_id", "left").where(broken).select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("queue"),
            F.col("text").alias("payload"),
            F.when(F.col("short"), "too short").otherwise("low quality").alias("error"),
            stamp.alias("timestamp"),
            stamp.alias("enqueued_at"),
            F.lit(0).alias("retry_count"),
        )

    @cached_property
    def acyclic_edges(self) -> DataFrame:
        turns = self.read("conversations").select("conv_id", "turn")
        following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
        return turns.join(following, ["conv_id", "turn"], "left_semi").select(
            F.col("conv_id").alias("graph"), F.col("turn").alias("src"), (F.col("turn") + 1).alias("dst")
        )

    @cached_property
    def acyclic_nodes(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").alias("graph"),
            F.col("turn").alias("node"),
            F.col("role").alias("type"),
            F.col("text").alias("function"),
        )


def EXECUTION_COLUMNS() -> list:
    """Order columns seen as one pipeline execution."""
    status = (
        F.when(F.col("o_orderstatus") == "P", "pending")
        .when(F.col("o_orderstatus") == "O", "running")
        .when(F.col("o_orderpriority") == "1-URGENT", "failed")
        .otherwise("completed")
    )
    return [
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("pipeline_id"),
        status.alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("cost"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("start_time"),
        F.when(
            F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
        ).alias("end_time"),
    ]


def TASK_COLUMNS() -> list:
    """Line-item columns seen as one task of an execution."""
    status = (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_returnflag") == "A", "completed")
        .when(F.col("l_linestatus") == "F", "running")
        .otherwise("pending")
    )
    terminal = F.col("l_returnflag").isin("R", "A")
    end_time = F.col("l_shipdate") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("l_quantity").cast("decimal(18,6)")
    )
    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("task_id"),
        F.col("l_orderkey").alias("execution_id"),
        F.col("l_linenumber").alias("node_id"),
        F.col("l_suppkey").alias("worker_id"),
        F.col("l_partkey").alias("function_id"),
        status.alias("status"),
        F.col("l_shipdate").alias("start_time"),
        F.when(terminal, end_time).alias("end_time"),
        (F.col("l_linenumber") - 1).alias("retry_count"),
        F.col("l_quantity").cast("bigint").alias("items"),
    ]


SQL_VIEWS = {
    "executions": """
        SELECT o_orderkey AS id, o_custkey AS pipeline_id,
               CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running'
                    WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'completed' END AS status,
               o_orderpriority AS priority, o_totalprice AS cost,
               o_orderdate AS created_at, o_orderdate AS start_time,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS end_time
        FROM orders""",
    "tasks": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS task_id,
               l_orderkey AS execution_id, l_linenumber AS node_id, l_suppkey AS worker_id,
               l_partkey AS function_id,
               CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'completed'
                    WHEN l_linestatus = 'F' THEN 'running' ELSE 'pending' END AS status,
               l_shipdate AS start_time,
               CASE WHEN l_returnflag IN ('R', 'A') THEN l_shipdate + to_seconds(l_quantity) END AS end_time,
               l_linenumber - 1 AS retry_count, CAST(l_quantity AS BIGINT) AS items
        FROM lineitem""",
    "pipelines": """
        SELECT c_custkey AS id, c_name AS name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'draft' WHEN 'MACHINERY' THEN 'paused'
                    WHEN 'HOUSEHOLD' THEN 'stopped' ELSE 'active' END AS status,
               c_acctbal AS budget
        FROM customer""",
    "pipeline_versions": """
        SELECT o_custkey AS pipeline_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version,
               o_orderkey AS version_key, o_orderdate AS created_at,
               o_totalprice AS definition, o_orderpriority AS changelog
        FROM orders""",
    "functions": """
        SELECT p_partkey AS id, p_name AS name, p_size AS version, p_type AS type,
               CASE WHEN p_size <= 25 THEN 'active' ELSE 'inactive' END AS status
        FROM part""",
    "logs": """
        SELECT event_id AS log_id, ts AS "timestamp",
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
                    WHEN 'purchase' THEN 'INFO' ELSE 'DEBUG' END AS level,
               event_type AS service, user_id AS pipeline_id, user_id % 8 AS node_id,
               props AS message, value AS duration_ms
        FROM events""",
    "heartbeats": """
        SELECT event_id AS beat_id, user_id AS worker_id, ts AS "timestamp",
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS tasks_running,
               CASE WHEN event_type = 'error' THEN 'lost' ELSE 'running' END AS status
        FROM events""",
    "metric_samples": """
        SELECT event_id AS sample_id, 'duration_ms' AS metric, event_type AS label_type,
               user_id AS label_user, ts AS "timestamp", value
        FROM events""",
    "status_events": """
        SELECT event_id AS event_seq, user_id AS pipeline_id, ts AS "timestamp",
               CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'active'
                    WHEN 'signup' THEN 'paused' WHEN 'purchase' THEN 'stopped' ELSE 'failed' END AS status
        FROM events""",
    "page_files": "SELECT page_id AS file_id, url AS path, html AS content FROM pages",
    "document_files": """
        SELECT doc_id AS file_id, source || '/' || doc_id || '.md' AS path, source AS parent, text AS content
        FROM documents""",
    "records": """
        SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "dead_letters": """
        SELECT doc_id AS id, source AS queue, text AS payload,
               CASE WHEN strlen(text) < 200 THEN 'too short' ELSE 'low quality' END AS error,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS "timestamp",
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS enqueued_at, 0 AS retry_count
        FROM records WHERE coalesce(quality = 0, false) OR strlen(text) < 200""",
    "acyclic_edges": """
        SELECT a.conv_id AS graph, a.turn AS src, a.turn + 1 AS dst
        FROM conversations a SEMI JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "acyclic_nodes": """
        SELECT conv_id AS graph, turn AS node, role AS type, text AS function FROM conversations""",
}
