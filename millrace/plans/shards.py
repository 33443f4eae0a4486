"""Queries over sharding, gathering and user functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.functions.encode import fnv1a_hex
from millrace.functions.registry import chain, registry
from millrace.functions.udfs import record_function, scan_function
from millrace.operators import gather, ordering, sharding
from millrace.operators.metrics import exact_sum
from millrace.operators.sharding import ShardSpec
from millrace.plans.registry import query


def fnv_sql(key: str) -> str:
    """64-bit FNV-1a in SQL, folding over the bytes as HUGEINT."""
    return f"""list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)],
        list_transform(range(1, strlen({key}) + 1),
            lambda i: CAST(CAST('0x' || substring(hex(encode({key})), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER) AS HUGEINT))),
        lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT))"""


@query(
    "shard_hash",
    f"""SELECT c_custkey, c_name, CAST({fnv_sql("c_name")} % 10 AS INTEGER) AS shard_id FROM customer""",
)
def shard_hash(t):
    customers = t.customer.select("c_custkey", "c_name")
    return sharding.shard(customers, ShardSpec(10, key="c_name"))


@query("shard_hash_hex", f"SELECT doc_id, lower(printf('%016x', CAST({fnv_sql('source')} AS UBIGINT))) AS hash FROM documents")
def shard_hash_hex(t):
    return t.documents.select("doc_id", fnv1a_hex(F.col("source")).alias("hash"))


@query(
    "shard_range",
    """SELECT p_partkey, p_name, CASE WHEN p_name < 'm' THEN 0 WHEN p_name < 'p' THEN 1 WHEN p_name < 'v' THEN 2 ELSE 0 END AS shard_id
       FROM part""",
)
def shard_range(t):
    return sharding.shard(t.part.select("p_partkey", "p_name"), ShardSpec(3, "range", "p_name", bounds=("m", "p", "v")))


@query(
    "shard_round_robin",
    """SELECT event_id, event_type, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 7 AS INTEGER) AS shard_id FROM events""",
)
def shard_round_robin(t):
    spec = ShardSpec(7, "round_robin", order_by=("ts", "event_id"), slice_by=ordering.time_slice("ts", "minute"))
    return sharding.shard(t.events.select("event_id", "ts", "event_type"), spec).drop("ts")


@query(
    "shard_config",
    f"""SELECT o_orderkey, CAST({fnv_sql("CAST(o_orderkey AS VARCHAR)")} % 16 AS INTEGER) AS shard_id, 'orders' AS origin FROM orders""",
)
def shard_config(t):
    spec = ShardSpec(16, "no-such-strategy", "o_orderkey", metadata={"origin": "orders"})
    laid_out = sharding.lay_out(sharding.shard(t.orders.select("o_orderkey"), spec), 16, parts=2)
    return laid_out.select("o_orderkey", "shard_id", F.col("shard_meta")["origin"].alias("origin"))


@query(
    "shard_balance",
    f"""WITH s AS (SELECT CAST({fnv_sql("source")} % 12 AS INTEGER) AS shard_id FROM documents),
             c AS (SELECT CAST(r.range AS INTEGER) AS shard_id, count(s.shard_id) AS rows
                   FROM range(12) r LEFT JOIN s ON r.range = s.shard_id GROUP BY 1)
        SELECT shard_id, rows, avg(rows) OVER () AS mean_rows, rows < avg(rows) OVER () * 0.5 AS under_filled FROM c""",
)
def shard_balance(t):
    return sharding.balance(sharding.shard(t.documents.select("source"), ShardSpec(12, key="source")), 12)


def shard_results(t):
    """Line items as results of shard tasks; the shard follows from the order key."""
    return t.tasks.select(
        "task_id",
        "execution_id",
        "node_id",
        "status",
        "items",
        "start_time",
        (F.col("execution_id") % 16).cast("int").alias("shard_id"),
        F.create_map(F.format_string("worker-%d", "worker_id"), F.col("items")).alias("result"),
    )


@query(
    "agg_merge",
    """SELECT 'worker-' || worker_id AS key, arg_max(items, (execution_id, node_id, task_id)) AS value
       FROM tasks WHERE status = 'completed' GROUP BY worker_id""",
)
def agg_merge(t):
    return gather.gather(shard_results(t), "no-such-name", result="result", order_by=["execution_id", "node_id", "task_id"])


@query(
    "agg_concat",
    """SELECT task_id, CAST(execution_id % 16 AS INTEGER) AS shard_id, items,
              row_number() OVER (ORDER BY execution_id % 16, start_time, task_id) AS position
       FROM tasks WHERE status = 'completed'""",
)
def agg_concat(t):
    placed = gather.gather(
        shard_results(t),
        "concat",
        order_by=["shard_id", "start_time", "task_id"],
        slice_by=F.struct("shard_id", ordering.time_slice("start_time", "day")),
    )
    return placed.select("task_id", "shard_id", "items", "position")


@query(
    "agg_reduce",
    """SELECT CAST(execution_id % 16 AS INTEGER) AS shard_id, CAST(sum(items) AS BIGINT) AS total, max(items) AS largest
       FROM tasks WHERE status = 'completed' GROUP BY 1""",
)
def agg_reduce(t):
    return gather.gather(
        shard_results(t), "reduce", keys=["shard_id"], aggregates={"total": F.sum("items"), "largest": F.max("items")}
    )


@query(
    "agg_ordered",
    """WITH s AS (SELECT execution_id % 16 AS shard, sum(items) AS total FROM tasks WHERE status = 'completed' GROUP BY 1)
       SELECT string_agg(CAST(total AS VARCHAR), ',' ORDER BY shard) AS values FROM s""",
)
def agg_ordered(t):
    return gather.ordered(shard_results(t), F.sum("items")).select(F.array_join("values", ",").alias("values"))


@query(
    "agg_errors",
    """SELECT task_id, 'node ' || node_id || ' failed after ' || retry_count || ' retries' AS error
       FROM tasks WHERE status = 'failed'""",
)
def agg_errors(t):
    message = F.format_string("node %d failed after %d retries", "node_id", "retry_count")
    return t.tasks.where(F.col("status") == "failed").select("task_id", message.alias("error"))


@query(
    "collector",
    """SELECT 'result' AS kind, id AS key, '{"id":' || id || ',"status":"' || status || '"}' AS result,
              CAST(NULL AS BIGINT) AS processed_count FROM executions
       UNION ALL SELECT 'summary', NULL, NULL, count(*) FROM executions""",
)
def collector(t):
    return gather.collector(t.executions.select("id", "status"), "id")


@query(
    "udf_record",
    """SELECT c_custkey, upper(c_mktsegment) AS segment, c_acctbal * 2 AS doubled, c_acctbal < 0 AS overdrawn FROM customer""",
)
def udf_record(t):
    def execute(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "c_custkey": rows["c_custkey"],
                "segment": rows["c_mktsegment"].str.upper(),
                "doubled": rows["c_acctbal"] * 2,
                "overdrawn": rows["c_acctbal"] < 0,
            }
        )

    schema = "c_custkey bigint, segment string, doubled double, overdrawn boolean"
    return record_function(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), execute, schema)


@query(
    "udtf_scan",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, strlen(lines[i]) AS n_bytes
       FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, 100000) r(i)
       WHERE i <= len(lines)""",
)
def udtf_scan(t):
    def scan(text: str):
        for number, line in enumerate(text.split("\n")):
            yield number, len(line.encode("utf-8"))

    return scan_function(t.documents, "doc_id", "text", scan, "line_no int, n_bytes bigint")


@query(
    "udaf_custom",
    "SELECT l_suppkey, count(*) AS n, bit_xor(l_orderkey) AS fingerprint FROM lineitem GROUP BY l_suppkey",
)
def udaf_custom(t):
    single = t.lineitem.select("l_suppkey", F.lit(1).cast("bigint").alias("n"), F.col("l_orderkey").alias("fingerprint"))
    return gather.fold(single, ["l_suppkey"], {"n": np.add, "fingerprint": np.bitwise_xor})


@query(
    "udf_setup",
    "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS BIGINT) AS numbers FROM documents",
)
def udf_setup(t):
    """A pattern compiled once per task and handed back when the task ends."""

    def execute(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        counts = [len(state["number"].findall(text)) for text in rows["text"].fillna("")]
        return pd.DataFrame({"doc_id": rows["doc_id"], "numbers": counts})

    documents = t.documents.select("doc_id", "text")
    return record_function(
        documents, execute, "doc_id bigint, numbers bigint", lambda: {"number": re.compile("[0-9]+")}, dict.clear
    )


@registry.register("net_price", "v1", "normal")
def net_price(df):
    """Price after discount."""
    return df.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@registry.register("net_price", "v2", "normal")
def list_price(df):
    """Price without discount."""
    return df.withColumn("net", F.col("l_extendedprice"))


@registry.register("gross_price", "v1", "normal")
def gross_price(df):
    """Net price with tax; uses the output of the step before."""
    return df.withColumn("gross", F.col("net") * (1 + F.col("l_tax")))


@registry.register("revenue", "latest", "end")
def revenue(df):
    """Revenue per return flag."""
    return df.groupBy("l_returnflag").agg(exact_sum(F.col("gross")).alias("gross"), F.count(F.lit(1)).alias("n"))


@query(
    "function_chain",
    """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(28, 6))) AS DOUBLE) AS gross,
              count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def function_chain(t):
    columns = ["l_returnflag", "l_extendedprice", "l_discount", "l_tax"]
    return chain(t.lineitem.select(*columns), ["identity", "net_price", "gross_price", "revenue"])


@query(
    "function_lookup",
    """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * (1 + l_tax) AS DECIMAL(28, 6))) AS DOUBLE) AS gross, count(*) AS n
       FROM lineitem GROUP BY l_returnflag""",
)
def function_lookup(t):
    """One step by its version, one by the first default version and one by the second."""
    steps = [registry.get("net_price", "v2"), registry.get("gross_price"), registry.get("revenue")]
    return chain(t.lineitem.select("l_returnflag", "l_extendedprice", "l_discount", "l_tax"), steps)


def _ring_sql(shards: int) -> str:
    return f"""SELECT CAST(s.range AS INTEGER) AS shard_id, ('0x' || substr(md5(s.range || '#' || v.range), 1, 15))::BIGINT AS place
               FROM range({shards}) s, range(64) v"""


def _placed_sql(shards: int) -> str:
    return f"""SELECT k.o_orderkey, coalesce(r.shard_id, (SELECT arg_min(shard_id, place) FROM ({_ring_sql(shards)}))) AS shard_id
               FROM (SELECT o_orderkey, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT AS place FROM orders) k
               ASOF LEFT JOIN ({_ring_sql(shards)}) r ON k.place <= r.place"""


@query("shard_ring", _placed_sql(16))
def shard_ring(t):
    return sharding.shard(t.orders.select("o_orderkey"), ShardSpec(16, "hash", "o_orderkey", consistent=True, virtual_nodes=64))


@query(
    "shard_ring_moves",
    f"""SELECT count(*) AS keys, count(*) FILTER (a.shard_id <> b.shard_id) AS moved, count(*) FILTER (a.shard_id <> b.shard_id AND b.shard_id <> 16) AS between_old,
               count(*) FILTER (a.shard_id <> b.shard_id) <= 1.3 / 17 * count(*) AS few
        FROM ({_placed_sql(16)}) a JOIN ({_placed_sql(17)}) b USING (o_orderkey)""",
)
def shard_ring_moves(t):
    """What moves when a seventeenth shard comes: only keys that it takes over."""
    before, after = (sharding.ring_shard(F.col("o_orderkey"), n, 64) for n in (16, 17))
    both = t.orders.select(before.alias("a"), after.alias("b"))
    moved = both.agg(F.count("*").alias("keys"), F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count_if((F.col("a") != F.col("b")) & (F.col("b") != 16)).alias("between_old"))
    return moved.withColumn("few", F.col("moved") <= 1.3 / 17 * F.col("keys"))
