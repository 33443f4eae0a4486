"""Queries over sources, sinks, record transforms, joins and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import values
from millrace.operators import errors, joins, transforms
from millrace.plans.registry import query
from millrace.session import scratch
from millrace.sources import files, records, sinks


@query("file_inventory")
def file_inventory(t):
    return files.inventory(t.spark, t.sf_dir, types=[".parquet", "orders"]).select(
        "name", "relative_path", "size", "extension", "is_dir"
    )


_EXT = r"lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\.[^.]*)$', 1))"


@query(
    "file_filter",
    f"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, {_EXT} AS extension
        FROM pages WHERE ({_EXT} IN ('.html', '.htm') OR contains(lower(regexp_extract(url, '([^/]*)$', 1)), 'utm_'))
          AND NOT list_contains(string_split(url, '/')[:-2], 'fr')""",
)
def file_filter(t):
    path = F.col("url")
    wanted = files.wanted_file(path, [".html", ".HTM", "UTM_"]) & ~files.in_excluded_dir(path, ["fr", ".git"])
    return t.pages.where(wanted).select(
        "page_id", files.file_name(path).alias("name"), files.extension(path).alias("extension")
    )


@query(
    "file_list",
    """SELECT file_id, path, parent FROM document_files
       WHERE parent IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def file_list(t):
    toxic = t.records.where(F.col("toxic") == 1).select(F.col("source").alias("parent"))
    return files.list_directories(t.document_files, toxic)


@query(
    "file_exists",
    """SELECT r.doc_id, r.path, f.path IS NOT NULL AS found
       FROM (SELECT doc_id, source || '/' || (doc_id + 100) || '.md' AS path FROM documents) r
       LEFT JOIN document_files f ON r.path = f.path""",
)
def file_exists(t):
    requested = t.documents.select("doc_id", F.format_string("%s/%d.md", "source", F.col("doc_id") + 100).alias("path"))
    return files.existing(t.document_files, requested)


@query(
    "file_delete",
    """SELECT file_id, path FROM document_files
       WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def file_delete(t):
    low = t.labels.where(F.col("quality") == 0).select("doc_id")
    named = t.documents.join(low, "doc_id", "left_semi").select(F.format_string("%s/%d.md", "source", "doc_id").alias("path"))
    return files.deleted(files.stat(t.document_files), named).select("file_id", "path")


@query(
    "file_save",
    "SELECT file_id, path, parent, content FROM document_files",
)
def file_save(t):
    path = scratch(t.spark, "files")
    sinks.write(t.document_files, path, partition_by=["parent"])
    return t.spark.read.parquet(path).select("file_id", "path", "parent", "content")


@query(
    "source_sql",
    """SELECT r_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY r_name""",
)
def source_sql(t):
    return files.query_source(
        t.spark,
        """SELECT r_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
           FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
           GROUP BY r_name""",
        {"customer": t.customer, "nation": t.nation, "region": t.region},
    )


@query("source_file", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_file(t):
    return files.file_source(t.spark, t.path("supplier"), "parquet")


@query(
    "json_ingest",
    """WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS raw
                  FROM events)
       SELECT event_id, CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.k') AS BIGINT) END AS k,
              NOT json_valid(raw) AS malformed FROM x""",
)
def json_ingest(t):
    broken = F.expr("left(props, length(props) - 1)")
    raw = t.events.select("event_id", F.when(F.col("event_type") == "error", broken).otherwise(F.col("props")).alias("raw"))
    return records.ingest(raw, "raw", "k BIGINT").select("event_id", F.col("record.k").alias("k"), "malformed")


@query(
    "json_documents",
    """WITH x AS (
           SELECT 'dead_letter' AS kind, event_id AS key, event_type AS a, props AS b, user_id % 1000 AS n, ts AS stamp FROM events
           UNION ALL SELECT 'file_content', doc_id, 'doc-' || doc_id, sha256(text), strlen(text), NULL FROM documents
           UNION ALL SELECT 'data_record', p_partkey, p_name, CAST(p_size AS VARCHAR), 1, NULL FROM part
           UNION ALL SELECT 'definition', p_partkey, p_name, 'sink', p_size, NULL FROM part)
       SELECT kind, key, CASE WHEN key % 5 <> 0 THEN a END AS a, CASE WHEN key % 5 <> 0 THEN b END AS b,
              CASE WHEN key % 5 <> 0 THEN CAST(n AS BIGINT) END AS n, CASE WHEN key % 5 <> 0 THEN stamp END AS stamp,
              key % 5 = 0 AS malformed FROM x""",
)
def json_documents(t):
    """The platform's four kinds of JSON documents; every fifth has lost its last brace."""

    def ingested(rows, key, fields, schema, a, b, n, at=None):
        whole = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
        cut = F.when(F.col(key) % 5 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
        read = records.ingest(rows.select(F.col(key).cast("bigint").alias("key"), cut.alias("raw")), "raw", schema)
        at = F.lit(None) if at is None else F.col(at)
        return read.select("key", a.alias("a"), b.alias("b"), n.cast("bigint").alias("n"), at.cast("timestamp_ntz").alias("stamp"), "malformed")

    text = lambda name: F.col(name).cast("string")
    tags = F.create_map(F.lit("type"), F.col("event_type"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    letters = {"id": text("event_id"), "payload": F.col("props"), "metadata": tags, "timestamp": time, "retry_count": F.col("user_id") % 1000}
    name = F.concat(F.lit("doc-"), F.col("doc_id"))
    files = {"path": F.concat(F.lit("/docs/"), name), "name": name, "size": F.octet_length("text"), "content": F.col("text"), "compressed": F.lit(False)}
    kind = F.create_map(F.lit("type"), F.col("p_type"))
    data = {"id": text("p_partkey"), "name": F.col("p_name"), "data_type": F.lit("int"), "value": text("p_size"), "metadata": kind}
    node = lambda id_, name, after: F.struct(F.lit(id_).alias("id"), name.alias("name"), kind.alias("config"), after.alias("depends_on"))
    nothing = F.array().cast("array<string>")
    graph = {
        "nodes": F.array(node("source", F.lit("read"), nothing), node("sink", F.col("p_name"), F.array(F.lit("source")))),
        "edges": F.array(F.struct(F.lit("source").alias("from"), F.lit("sink").alias("to"))),
        "execution": F.struct(F.col("p_size").alias("parallelism"), F.struct(F.lit(3).alias("maxRetries")).alias("retryPolicy")),
    }
    record = F.col("record")
    steps = record["nodes"]
    kinds = {
        "dead_letter": ingested(t.events, "event_id", letters, records.DEAD_LETTER, record["metadata"]["type"], record["payload"], record["retry_count"], "record.timestamp"),
        "file_content": ingested(t.documents, "doc_id", files, records.FILE_CONTENT, record["name"], F.sha2(record["content"], 256), record["size"]),
        "data_record": ingested(t.part, "p_partkey", data, records.DATA_RECORD, record["name"], record["value"], F.when(~F.col("malformed"), F.size(record["metadata"]))),
        "definition": ingested(
            t.part, "p_partkey", graph, records.DEFINITION, F.try_element_at(F.filter(steps, lambda x: F.array_contains(x["depends_on"], "source")), F.lit(1))["name"],
            F.try_element_at(record["edges"], F.lit(1))["to"], record["execution"]["parallelism"],
        ),
    }
    return reduce(DataFrame.unionByName, [rows.withColumn("kind", F.lit(kind)) for kind, rows in kinds.items()])


@query("sink_roundtrip", "SELECT event_id, user_id, event_type, value, props FROM events")
def sink_roundtrip(t):
    path = scratch(t.spark, "sink")
    sinks.write(t.events.select("event_id", "user_id", "event_type", "value", "props"), path, batch_size=10_000)
    return t.spark.read.parquet(path)


@query(
    "sink_csv_json",
    """SELECT 'csv' AS form, doc_id, text FROM documents UNION ALL SELECT 'json', doc_id, text FROM documents""",
)
def sink_csv_json(t):
    frames = []
    for form in ("csv", "json"):
        path = scratch(t.spark, form)
        sinks.write(t.documents.select("doc_id", "text"), path, form)
        options = {"header": "true", "multiLine": "true", "escape": '"'} if form == "csv" else {}
        back = files.file_source(t.spark, path, form, "doc_id BIGINT, text STRING", **options)
        frames.append(back.select(F.lit(form).alias("form"), "doc_id", "text"))
    return transforms.append_all(*frames)


@query(
    "sink_compressed",
    """SELECT c.codec, n_nationkey AS key, n_name AS name FROM nation
       CROSS JOIN (VALUES ('none'), ('gzip'), ('lz4'), ('zstd')) c(codec)
       UNION ALL SELECT c.codec, CAST(p_partkey AS INTEGER), p_name FROM part
       CROSS JOIN (VALUES ('none'), ('gzip'), ('lz4'), ('zstd')) c(codec)""",
)
def sink_compressed(t):
    source = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(
        t.part.select(F.col("p_partkey").cast("int").alias("key"), F.col("p_name").alias("name"))
    )
    frames = []
    for name in ("none", "gzip", "lz4", "zstd"):
        path = scratch(t.spark, name)
        sinks.write(source, path, compression=name)
        frames.append(t.spark.read.parquet(path).select(F.lit(name).alias("codec"), "key", "name"))
    return transforms.append_all(*frames)


@query(
    "transform_map",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net,
              upper(l_returnflag) || l_linestatus AS state FROM lineitem""",
)
def transform_map(t):
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
    )
    return transforms.compute(
        lines, net="l_extendedprice * (1 - l_discount)", state="upper(l_returnflag) || l_linestatus"
    ).drop("l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


@query("transform_rename", "SELECT c_custkey AS id, c_name AS full_name, c_nationkey FROM customer")
def transform_rename(t):
    return transforms.rename(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey -> id, c_name -> full_name")


@query(
    "transform_convert",
    """SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS number,
              TRY_CAST(regexp_extract(url, '^([a-z]+)', 1) AS DOUBLE) AS scheme FROM pages""",
)
def transform_convert(t):
    raw = t.pages.select(
        "page_id",
        F.regexp_extract("url", "/([0-9]+)", 1).alias("number"),
        F.regexp_extract("url", "^([a-z]+)", 1).alias("scheme"),
    )
    return transforms.convert(raw, number="int", scheme="double")


@query(
    "transform_flatten",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k, event_type AS kind_name,
              user_id AS kind_owner FROM events""",
)
def transform_flatten(t):
    nested = t.events.select(
        "event_id",
        F.from_json("props", "k BIGINT").alias("props"),
        F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("owner")).alias("kind"),
    )
    return transforms.flatten(nested)


@query("filter_keep", "SELECT doc_id, lang, quality FROM records WHERE coalesce(quality = 1 AND lang <> 'en', false)")
def filter_keep(t):
    return joins.keep(t.records.select("doc_id", "lang", "quality"), (F.col("quality") == 1) & (F.col("lang") != "en"))


@query(
    "filter_drop",
    "SELECT doc_id, lang, quality FROM records WHERE NOT coalesce(quality = 1 AND lang <> 'en', false)",
)
def filter_drop(t):
    condition = (F.col("quality") == 1) & (F.col("lang") != "en")
    return joins.keep(t.records.select("doc_id", "lang", "quality"), condition, keep_matches=False)


@query(
    "context_merge",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'code=E,service=override'
                             ELSE 'service=' || event_type || ',user=' || user_id END AS context,
              CASE WHEN event_type = 'error' THEN 'code=E,service=override,user=' || user_id
                   ELSE 'service=' || event_type || ',user=' || user_id END AS merged
       FROM events""",
)
def context_merge(t):
    stored = F.create_map(F.lit("service"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    call = F.when(
        F.col("event_type") == "error", F.create_map(F.lit("service"), F.lit("override"), F.lit("code"), F.lit("E"))
    )
    both = F.coalesce(values.merge_maps(stored, call), stored)
    return t.events.select(
        "event_id",
        values.sorted_pairs(F.coalesce(call, stored)).alias("context"),
        values.sorted_pairs(both).alias("merged"),
    )


@query(
    "inputs_defaulted",
    """SELECT doc_id, coalesce(quality, -1) AS quality, toxic, lang,
              CASE WHEN toxic IS NULL THEN 'toxic' ELSE '' END AS missing_inputs FROM records""",
)
def inputs_defaulted(t):
    chosen = t.records.select("doc_id", "quality", "toxic", "lang")
    return transforms.with_defaults(chosen, {"quality": (True, -1), "toxic": (True, None), "lang": (False, None)})


@query(
    "port_compat",
    """WITH p AS (SELECT graph, node, CASE type WHEN 'user' THEN 'string' WHEN 'assistant' THEN 'object' ELSE 'any' END AS tag
                  FROM acyclic_nodes)
       SELECT e.graph, e.src, e.dst, s.tag AS source_tag, d.tag AS target_tag,
              s.tag = 'any' OR d.tag = 'any' OR s.tag = d.tag AS compatible
       FROM acyclic_edges e JOIN p s ON e.graph = s.graph AND e.src = s.node
       JOIN p d ON e.graph = d.graph AND e.dst = d.node""",
)
def port_compat(t):
    raw = F.when(F.col("type") == "user", "STRING").when(F.col("type") == "assistant", "object").otherwise("blob")
    ports = t.acyclic_nodes.select("graph", "node", raw.alias("tag"))
    source = ports.select("graph", F.col("node").alias("src"), F.col("tag").alias("source_tag"))
    target = ports.select("graph", F.col("node").alias("dst"), F.col("tag").alias("target_tag"))
    joined = t.acyclic_edges.join(source, ["graph", "src"]).join(target, ["graph", "dst"])
    a, b = F.col("source_tag"), F.col("target_tag")
    return joined.select(
        "graph",
        "src",
        "dst",
        transforms.port_tag(a).alias("source_tag"),
        transforms.port_tag(b).alias("target_tag"),
        transforms.compatible(a, b).alias("compatible"),
    )


@query(
    "join_inner",
    "SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_inner(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    customer = t.customer.select("c_custkey", "c_name")
    return joins.join_node(orders, customer, orders["o_custkey"] == customer["c_custkey"]).drop("c_custkey")


@query("join_left", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(t):
    return joins.join_node(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "left")


@query("join_right", "SELECT doc_id, d.lang, l.quality FROM documents d RIGHT JOIN labels l USING (doc_id)")
def join_right(t):
    return joins.join_node(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id", "right")


@query(
    "join_full",
    """SELECT coalesce(d.doc_id, b.item_id + 990) AS doc_id, d.lang, b.text AS passage
       FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id + 990""",
)
def join_full(t):
    passages = t.benchmark.select((F.col("item_id") + 990).alias("doc_id"), F.col("text").alias("passage"))
    return joins.join_node(t.documents.select("doc_id", "lang"), passages, "doc_id", "full")


@query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def join_semi(t):
    big = t.orders.where(F.col("o_totalprice") > 400_000).select(F.col("o_custkey").alias("c_custkey"))
    return joins.join_node(t.customer.select("c_custkey", "c_name"), big, "c_custkey", "left_semi")


@query(
    "join_anti",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def join_anti(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.join_node(t.orders.select("o_orderkey", "o_custkey"), lines, "o_orderkey", "left_anti")


@query(
    "join_theta",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice FROM lineitem JOIN part
       ON l_partkey = p_partkey AND l_extendedprice > p_retailprice * 40 AND l_quantity < p_size""",
)
def join_theta(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    parts = t.part.select("p_partkey", "p_retailprice", "p_size")
    condition = (
        (lines["l_partkey"] == parts["p_partkey"])
        & (lines["l_extendedprice"] > parts["p_retailprice"] * 40)
        & (lines["l_quantity"] < parts["p_size"])
    )
    return joins.join_node(lines, parts, condition).select("l_orderkey", "l_linenumber", "l_partkey", "p_retailprice")


@query(
    "union_all",
    """SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""",
)
def union_all(t):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return transforms.append_all(suppliers, customers)


@query(
    "distinct_first",
    """SELECT text, doc_id, source FROM documents
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def distinct_first(t):
    keyed = t.documents.select(F.sha2("text", 256).alias("digest"), "doc_id", "source", "text")
    return transforms.distinct_first(keyed, ["digest"], "doc_id").select("text", "doc_id", "source")


_CODES = ", ".join(f"'{c}'" for c in errors.CODES)
_RETRY = ", ".join(f"'{c}'" for c in errors.RETRYABLE)
_FATAL = ", ".join(f"'{c}'" for c in errors.FATAL)
_ERR = f"""e AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS number,
                        [{_CODES}][CAST(json_extract_string(props, '$.k') AS BIGINT) + 1] AS code
                 FROM events WHERE event_type = 'error')"""


def error_rows(t):
    number = F.get_json_object("props", "$.k").cast("bigint")
    failed = t.events.where(F.col("event_type") == "error")
    return failed.select("event_id", "user_id", "ts", number.alias("number"), errors.code_name(number).alias("code"))


@query(
    "error_classes",
    f"""WITH {_ERR}
        SELECT event_id, coalesce(code, 'UNKNOWN') AS code,
               CASE WHEN code IN ({_RETRY}) THEN 'retryable' WHEN code IN ({_FATAL}) THEN 'fatal' ELSE 'other' END AS class
        FROM e""",
)
def error_classes(t):
    return error_rows(t).select("event_id", "code", errors.code_class(F.col("code")).alias("class"))


@query(
    "errors_with_code",
    f"WITH {_ERR} SELECT event_id, user_id, code FROM e WHERE code = 'REQUEST_TIMEOUT'",
)
def errors_with_code(t):
    return error_rows(t).where(F.col("code") == "REQUEST_TIMEOUT").select("event_id", "user_id", "code")


@query(
    "error_summary",
    f"""WITH {_ERR}
        SELECT user_id, count(*) AS errors, bool_or(coalesce(code, 'UNKNOWN') = 'RESOURCE_BUSY') AS has_code,
               arg_min(coalesce(code, 'UNKNOWN'), event_id) AS first_error
        FROM e GROUP BY user_id""",
)
def error_summary(t):
    return errors.error_summary(error_rows(t), "user_id", "RESOURCE_BUSY", ["ts", "event_id"])


@query(
    "retry_decision",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS attempt,
                          CASE WHEN l_returnflag = 'R' THEN [{_CODES}][l_partkey % 71 + 1] END AS code FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN code IS NULL THEN true ELSE attempt < 5 AND code NOT IN ({_FATAL}) END AS retry FROM x""",
)
def retry_decision(t):
    code = F.when(F.col("l_returnflag") == "R", errors.code_name(F.col("l_partkey") % len(errors.CODES)))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        errors.should_retry(F.col("l_linenumber"), code, 5).alias("retry"),
    )


@query(
    "retry_stats",
    """SELECT execution_id, count(*) AS attempts,
              CAST(sum(coalesce((epoch_us(end_time) - epoch_us(start_time)) // 1000, 0)) AS BIGINT) AS total_ms,
              max(node_id) AS last_attempt, arg_max(start_time, (node_id, start_time)) AS last_start
       FROM tasks GROUP BY execution_id""",
)
def retry_stats(t):
    attempts = t.tasks.select("execution_id", F.col("node_id").alias("attempt"), "start_time", "end_time")
    return errors.retry_stats(attempts, "execution_id")


@query(
    "backoff_schedule",
    """WITH d AS (
           SELECT o_orderkey, n, CAST(least(100.0 * pow(2.0, n - 1), 3000.0) AS BIGINT) AS exponential,
                  CAST(least(100 + 100 * (n - 1), 450) AS BIGINT) AS linear, CAST(100 AS BIGINT) AS fixed
           FROM orders, range(1, 8) r(n)),
       w AS (SELECT *, CAST(sum(exponential) OVER (PARTITION BY o_orderkey ORDER BY n) AS BIGINT) AS waited FROM d)
       SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, w.exponential, w.linear, w.fixed, w.waited
       FROM lineitem l JOIN w ON l.l_orderkey = w.o_orderkey AND l.l_linenumber = w.n""",
)
def backoff_schedule(t):
    n = F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        errors.backoff_delay(n, "unknown-name", 100, max_ms=3000).alias("exponential"),
        errors.backoff_delay(n, "linear", 100, 100, max_ms=450).alias("linear"),
        errors.backoff_delay(n, "fixed", 100).alias("fixed"),
        errors.total_backoff(n, "exponential", initial_ms=100, max_ms=3000).alias("waited"),
    )
