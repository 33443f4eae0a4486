"""Queries over validation, quality, quarantine and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.encode import checksum as digest
from millrace.functions.values import sorted_pairs
from millrace.operators import graph, joins, ordering, quality, quarantine, validation
from millrace.operators.validation import FieldRule, issues_text
from millrace.operators.validators import from_settings
from millrace.plans.registry import query
from millrace.session import scratch
from millrace.sources import sinks

DOCUMENT_RULES = (
    FieldRule("text", required=True, type="string", min_length=200, max_length=20_000),
    FieldRule("lang", required=True, type="string", pattern="^[df]", enum=("de", "en")),
)
LABEL_RULES = (
    FieldRule("quality", required=True, type="int", min_value=1.0),
    FieldRule("toxic", type="integer", max_value=0.0),
    FieldRule("absent", required=True),
)


def join_labels(t, documents):
    """Left join of the labels. Texts are checked before the join, so that only the findings are shuffled."""
    return documents.join(t.labels, "doc_id", "left")


def checked_documents(t, *columns, rules=DOCUMENT_RULES):
    """Documents with the errors of their own fields, without the text unless asked for."""
    documents = t.documents
    return documents.select("doc_id", *columns, validation.rule_errors(documents.schema, rules).alias("text_errors"))


def label_errors(t, rules=LABEL_RULES):
    return validation.rule_errors(t.labels.schema, rules)

_TEXT = """CASE WHEN text IS NULL THEN 'text: required field is missing'
                WHEN strlen(text) < 200 THEN 'text: length must be at least 200'
                WHEN strlen(text) > 20000 THEN 'text: length must be at most 20000' END"""
_LANG = """CASE WHEN lang IS NULL THEN 'lang: required field is missing'
                WHEN NOT regexp_matches(lang, '^[df]') THEN 'lang: value does not match pattern'
                WHEN lang NOT IN ('de', 'en') THEN 'lang: value must be one of [de en]' END"""
_QUALITY = """CASE WHEN quality IS NULL THEN 'quality: required field is missing'
                   WHEN quality < 1 THEN 'quality: value must be at least 1.000000' END"""
_TOXIC = "CASE WHEN toxic > 0 THEN 'toxic: value must be at most 0.000000' END"
_RULES = f"concat_ws('; ', {_TEXT}, {_LANG}, {_QUALITY}, {_TOXIC})"


@query(
    "validate_rules",
    f"SELECT doc_id, {_RULES} AS errors, {_RULES} = '' AS valid FROM records",
)
def validate_rules(t):
    joined = join_labels(t, checked_documents(t))
    errors = validation.chain(F.col("text_errors"), label_errors(t))
    return joined.select("doc_id", issues_text(errors).alias("errors"), (F.size(errors) == 0).alias("valid"))


_VARIED = """CASE event_type WHEN 'click' THEN '{"v":' || json_extract_string(props, '$.k') || '}'
                  WHEN 'error' THEN '{"v":"' || json_extract_string(props, '$.k') || '"}'
                  WHEN 'purchase' THEN '{"v":' || json_extract_string(props, '$.k') || '.5}'
                  WHEN 'view' THEN '{"v":[' || event_id || ']}'
                  WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '{"v":{"a":true}}' ELSE '{"v":false}' END END"""


@query(
    "validate_types",
    f"""WITH x AS (SELECT event_id, event_type, {_VARIED} AS doc FROM events)
        SELECT event_id, json_type(doc, '$.v') = 'VARCHAR' AS is_string,
               json_type(doc, '$.v') IN ('UBIGINT', 'BIGINT') AS is_integer,
               event_type IN ('click', 'error', 'purchase') AS is_float,
               json_type(doc, '$.v') = 'BOOLEAN' AS is_boolean, json_type(doc, '$.v') = 'ARRAY' AS is_array,
               json_type(doc, '$.v') = 'OBJECT' AS is_object, json_type(doc, '$.w') IS NULL AS is_null
        FROM x""",
)
def validate_types(t):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    doc = (
        F.when(kind == "click", F.format_string('{"v":%s}', k))
        .when(kind == "error", F.format_string('{"v":"%s"}', k))
        .when(kind == "purchase", F.format_string('{"v":%s.5}', k))
        .when(kind == "view", F.format_string('{"v":[%d]}', "event_id"))
        .when(F.col("event_id") % 2 == 0, '{"v":{"a":true}}')
        .otherwise('{"v":false}')
    )
    varied = t.events.select("event_id", doc.alias("doc")).select(
        "event_id",
        validation.json_kind(F.col("doc"), "$.v").alias("kind"),
        validation.json_kind(F.col("doc"), "$.w").alias("missing"),
    )
    names = ("string", "integer", "float", "boolean", "array", "object")
    tests = [validation.kind_fits(F.col("kind"), n).alias(f"is_{n}") for n in names]
    return varied.select("event_id", *tests, validation.kind_fits(F.col("missing"), "null").alias("is_null"))


@query(
    "checksum",
    """SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, strlen(text) AS input_size
       FROM documents""",
)
def checksum(t):
    sums = [digest(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")]
    return t.documents.select("doc_id", *sums, F.octet_length("text").cast("bigint").alias("input_size"))


@query(
    "checksum_reconcile",
    """WITH a AS (SELECT doc_id, md5(text) AS actual FROM documents),
            e AS (SELECT d.doc_id + CASE WHEN l.toxic = 1 THEN 1000000 ELSE 0 END AS doc_id,
                         lower(upper(md5(CASE WHEN l.quality = 0 THEN lower(text) || '!' ELSE text END))) AS expected
                  FROM documents d JOIN labels l USING (doc_id))
       SELECT coalesce(a.doc_id, e.doc_id) AS doc_id, actual, expected,
              CASE WHEN expected IS NULL THEN 'unexpected' WHEN actual IS NULL THEN 'missing'
                   WHEN actual = expected THEN 'match' ELSE 'mismatch' END AS verdict
       FROM a FULL JOIN e ON a.doc_id = e.doc_id""",
)
def checksum_reconcile(t):
    actual = t.documents.select("doc_id", F.md5("text").alias("checksum"))
    changed = F.when(F.col("quality") == 0, F.concat(F.lower("text"), F.lit("!"))).otherwise(F.col("text"))
    moved = F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000).otherwise(0)
    expected = t.documents.join(t.labels, "doc_id").select(
        moved.alias("doc_id"), F.upper(F.md5(changed)).alias("checksum")
    )
    return joins.reconcile_checksums(actual, expected, "doc_id")


@query(
    "validate_json",
    """WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS raw
                  FROM events),
            y AS (SELECT event_id, CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.k') AS BIGINT) END AS k,
                         json_valid(raw) AS ok FROM x)
       SELECT event_id, CASE WHEN NOT ok THEN 'json: failed to parse JSON'
                             WHEN k < 10 THEN 'k: value must be at least 10.000000'
                             WHEN k > 90 THEN 'k: value must be at most 90.000000' ELSE '' END AS errors,
              ok AND k BETWEEN 10 AND 90 AS valid
       FROM y""",
)
def validate_json(t):
    broken = F.expr("left(props, length(props) - 1)")
    raw = t.events.select("event_id", F.when(F.col("event_type") == "error", broken).otherwise(F.col("props")).alias("raw"))
    rules = [FieldRule("k", required=True, type="int", min_value=10.0, max_value=90.0)]
    checked = validation.validate_json(raw, "raw", "k BIGINT", rules)
    return checked.select("event_id", issues_text(F.col("errors")).alias("errors"), "valid")


LENGTH_RULE = [FieldRule("text", min_length=200)]
SCORE_RULES = [FieldRule("quality", min_value=1.0), FieldRule("toxic", max_value=0.0)]


_LEN = "CASE WHEN strlen(text) < 200 THEN 'text: length must be at least 200' END"
_LAB = f"""nullif(concat_ws('; ', CASE WHEN quality < 1 THEN 'quality: value must be at least 1.000000' END, {_TOXIC}), '')"""


@query("validate_chain", f"SELECT doc_id, concat_ws('; ', {_LEN}, {_LAB}) AS errors FROM records")
def validate_chain(t):
    joined = join_labels(t, checked_documents(t, rules=LENGTH_RULE))
    errors = validation.chain(F.col("text_errors"), label_errors(t, SCORE_RULES))
    return joined.select("doc_id", issues_text(errors).alias("errors"))


@query("validate_chain_break", f"SELECT doc_id, coalesce({_LEN}, {_LAB}, '') AS errors FROM records")
def validate_chain_break(t):
    joined = join_labels(t, checked_documents(t, rules=LENGTH_RULE))
    errors = validation.chain_until_invalid(F.col("text_errors"), label_errors(t, SCORE_RULES))
    return joined.select("doc_id", issues_text(errors).alias("errors"))


@query(
    "validation_merge",
    f"""SELECT doc_id, coalesce(strlen(text) >= 200, true) AND {_LAB} IS NULL AS valid,
               concat_ws('; ', {_LEN}, {_LAB}) AS errors,
               CASE WHEN quality IS NULL THEN 'quality: not labelled' ELSE '' END AS warnings,
               'lang=' || lang || ',step=labels' AS metadata, 5 AS duration_ms
        FROM records""",
)
def validation_merge(t):
    length, labels = F.col("text_errors"), label_errors(t, SCORE_RULES)
    none = validation.no_issues()
    warned = F.when(
        F.col("quality").isNull(), F.array(validation.issue("quality", F.lit("not labelled")))
    ).otherwise(none)

    def result(errors, warnings, metadata, millis):
        return F.struct(
            (F.size(errors) == 0).alias("valid"),
            errors.alias("errors"),
            warnings.alias("warnings"),
            metadata.alias("metadata"),
            F.lit(millis).alias("duration_ms"),
        )

    first = result(length, none, F.create_map(F.lit("lang"), F.col("lang"), F.lit("step"), F.lit("length")), 2)
    second = result(labels, warned, F.create_map(F.lit("step"), F.lit("labels")), 3)
    joined = join_labels(t, checked_documents(t, "lang", rules=LENGTH_RULE))
    both = joined.select("doc_id", first.alias("a"), second.alias("b"))
    merged = both.select("doc_id", validation.merge_results("a", "b").alias("m"))
    return merged.select(
        "doc_id",
        "m.valid",
        issues_text(F.col("m.errors")).alias("errors"),
        issues_text(F.col("m.warnings")).alias("warnings"),
        sorted_pairs(F.col("m.metadata")).alias("metadata"),
        "m.duration_ms",
    )


@query(
    "validate_all",
    f"""SELECT doc_id, {_RULES} || CASE WHEN {_RULES} <> '' AND quality IS NULL THEN '; ' ELSE '' END
                       || CASE WHEN quality IS NULL THEN 'completeness: record is incomplete' ELSE '' END AS errors,
               sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}}') AS checksum
        FROM records""",
)
def validate_all(t):
    documents = t.documents
    payload = F.to_json(F.struct("doc_id", "lang", "source"))
    own = quality.profile_rows(documents, ["doc_id", "text", "lang", "source"]).select(
        "doc_id",
        validation.rule_errors(documents.schema, DOCUMENT_RULES).alias("text_errors"),
        digest(payload, "sha256").alias("checksum"),
        "cells_filled",
        "row_ok",
    )
    joined = join_labels(t, own)
    filled = F.col("cells_filled") + F.col("quality").isNotNull().cast("int") + F.col("toxic").isNotNull().cast("int")
    errors = validation.chain(F.col("text_errors"), label_errors(t), quality.row_errors(filled, F.col("row_ok"), 6))
    return joined.select("doc_id", issues_text(errors).alias("errors"), "checksum")


@query(
    "validate_custom",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'overdrawn builder'
                              WHEN c_acctbal < 0 THEN 'overdrawn' ELSE '' END AS message FROM customer""",
)
def validate_custom(t):
    def solvent(balance):
        builder = F.col("c_mktsegment") == "BUILDING"
        return F.when(balance < 0, F.when(builder, "overdrawn builder").otherwise("overdrawn"))

    validator = from_settings({"type": "schema", "rules": {"c_acctbal": {"custom": solvent}}})
    checked = t.customer.transform(validator)
    message = F.coalesce(F.get("errors", 0)["message"], F.lit(""))
    return checked.select("c_custkey", message.alias("message"))


_CELLS = "count(doc_id) + count(text) + count(lang) + count(source) + count(quality) + count(toxic)"
_DQ_SQL = f"""SELECT source AS grp, count(*) AS record_count, ({_CELLS}) / (count(*) * 6) AS completeness,
                     count(*) FILTER (strlen(text) >= 200) / count(*) AS accuracy,
                     (count(*) * 6 - ({_CELLS})) / (count(*) * 6) AS null_percent
              FROM records GROUP BY source"""


def _scored(t, group=()):
    blanked = t.documents.withColumn("lang", F.when(F.octet_length("text") < 200, "").otherwise(F.col("lang")))
    own = quality.profile_rows(blanked, ["doc_id", "text", "lang", "source"]).select(
        "doc_id", F.col("source").alias("grp"), "cells_filled", "row_ok"
    )
    labelled = F.col("quality").isNotNull().cast("int") + F.col("toxic").isNotNull().cast("int")
    joined = join_labels(t, own).withColumn("cells_filled", F.col("cells_filled") + labelled)
    return quality.score_rows(joined, 6, group)


@query(
    "dq_completeness",
    f"SELECT count(*) AS record_count, ({_CELLS}) / (count(*) * 6) AS completeness FROM records",
)
def dq_completeness(t):
    return _scored(t).select("record_count", "completeness")


@query("dq_accuracy", "SELECT count(*) FILTER (strlen(text) >= 200) / count(*) AS accuracy FROM records")
def dq_accuracy(t):
    return _scored(t).select("accuracy")


@query("dq_null_percent", f"SELECT (count(*) * 6 - ({_CELLS})) / (count(*) * 6) AS null_percent FROM records")
def dq_null_percent(t):
    return _scored(t).select("null_percent")


@query(
    "dq_verdict",
    f"""WITH s AS ({_DQ_SQL})
        SELECT *, concat_ws(',', CASE WHEN completeness < 0.8 THEN 'completeness' END,
                                 CASE WHEN accuracy < 0.9 THEN 'accuracy' END) AS failed,
               CASE WHEN null_percent > 0.1 THEN 'null_percent' ELSE '' END AS warned,
               completeness >= 0.8 AND accuracy >= 0.9 AS valid
        FROM s""",
)
def dq_verdict(t):
    judged = quality.verdict(_scored(t, ["grp"]))
    return judged.withColumns(
        {"failed": F.array_join("errors.field", ","), "warned": F.array_join("warnings.field", ",")}
    ).drop("errors", "warnings")


@query(
    "sink_with_verdict",
    """WITH s AS (SELECT count(*) AS record_count, (count(doc_id) + count(text) + count(lang) + count(source)) / (count(*) * 4) AS completeness,
                         count(*) FILTER (strlen(text) >= 200) / count(*) AS accuracy,
                         (count(*) * 4 - (count(doc_id) + count(text) + count(lang) + count(source))) / (count(*) * 4) AS null_percent
                  FROM documents)
       SELECT s.*, completeness >= 0.8 AND accuracy >= 0.9 AS valid, record_count AS written FROM s""",
)
def sink_with_verdict(t):
    """Documents are written once, and judged in the same pass."""
    blanked = t.documents.select("doc_id", "text", F.when(F.octet_length("text") < 200, "").otherwise(F.col("lang")).alias("lang"), "source")
    path = scratch(t.spark, "judged")
    judged = quality.judged_while(blanked, blanked.columns, lambda rows: sinks.write(rows, path))
    written = t.spark.read.schema(blanked.schema).parquet(path).count()
    return judged.drop("errors", "warnings").withColumn("written", F.lit(written).cast("long"))


@query("dq_duplicates", "SELECT p_name, p_type, count(*) AS copies FROM part GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(t):
    return quality.duplicates(t.part, ["p_name", "p_type"])


_NODES = """SELECT conv_id AS graph, CASE WHEN turn = 6 THEN ' ' ELSE CAST(turn // 2 AS VARCHAR) END AS node,
                   CASE WHEN role = 'system' THEN NULL ELSE role END AS type,
                   CASE WHEN length(text) < 120 THEN '' ELSE text END AS function FROM conversations"""


@query(
    "nodes_invalid",
    f"""WITH n AS ({_NODES})
        SELECT c_custkey AS graph, '' AS node, 'no nodes' AS problem FROM customer
        WHERE c_custkey NOT IN (SELECT graph FROM n)
        UNION ALL SELECT graph, node, 'node id is required' FROM n WHERE trim(node) = ''
        UNION ALL SELECT graph, node, 'node type is required' FROM n WHERE type IS NULL
        UNION ALL SELECT graph, node, 'node function is required' FROM n WHERE trim(function) = ''
        UNION ALL SELECT graph, node, 'duplicate node id' FROM n WHERE trim(node) <> ''
                  GROUP BY graph, node HAVING count(*) > 1""",
)
def nodes_invalid(t):
    nodes = t.conversations.select(
        F.col("conv_id").alias("graph"),
        F.when(F.col("turn") == 6, " ").otherwise(F.expr("cast(turn div 2 as string)")).alias("node"),
        F.when(F.col("role") != "system", F.col("role")).alias("type"),
        F.when(F.char_length("text") < 120, "").otherwise(F.col("text")).alias("function"),
    )
    return validation.node_problems(t.customer.select(F.col("c_custkey").alias("graph")), nodes)


@query(
    "edges_dangling",
    """WITH n AS (SELECT conv_id AS graph, turn AS node FROM conversations WHERE role <> 'system'),
            e AS (SELECT conv_id AS graph, turn AS src, CASE WHEN turn = 4 THEN 4 ELSE turn + 1 END AS dst
                  FROM conversations)
       SELECT graph, src, dst, 'unknown_source' AS problem FROM e ANTI JOIN n ON e.graph = n.graph AND e.src = n.node
       UNION ALL SELECT graph, src, dst, 'unknown_target' FROM e ANTI JOIN n ON e.graph = n.graph AND e.dst = n.node
       UNION ALL SELECT graph, src, dst, 'self_edge' FROM e WHERE src = dst""",
)
def edges_dangling(t):
    nodes = t.conversations.where(F.col("role") != "system").select(F.col("conv_id").alias("graph"), F.col("turn").alias("node"))
    target = F.when(F.col("turn") == 4, 4).otherwise(F.col("turn") + 1)
    edges = t.conversations.select(F.col("conv_id").alias("graph"), F.col("turn").alias("src"), target.alias("dst"))
    return joins.dangling_edges(nodes, edges)


_CYCLIC = """e AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS graph, event_type AS src,
                          lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst
                   FROM events QUALIFY dst IS NOT NULL)"""


def cyclic_edges(t):
    """Moves from one kind of event to the next, one graph per user and day."""
    events = t.events.select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    steps = ordering.with_previous(
        events, "event_type", ["ts", "event_id"], ordering.time_slice("ts", "hour"), ["user_id", "day"], "src"
    )
    graph_id = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd"))
    moves = steps.where(F.col("src").isNotNull())
    return moves.select(graph_id.alias("graph"), "src", F.col("event_type").alias("dst")).distinct()


@query(
    "dag_cycles",
    f"""WITH RECURSIVE {_CYCLIC},
        reach AS (SELECT graph, src, dst FROM e
                  UNION SELECT r.graph, r.src, e.dst FROM reach r JOIN e ON r.graph = e.graph AND r.dst = e.src),
        cyc AS (SELECT DISTINCT graph, src AS node FROM reach WHERE src = dst)
        SELECT graph, node FROM cyc
        UNION SELECT r.graph, r.dst FROM reach r JOIN cyc ON r.graph = cyc.graph AND r.src = cyc.node""",
)
def dag_cycles(t):
    return graph.cyclic_nodes(cyclic_edges(t))


@query(
    "dag_components",
    f"""WITH RECURSIVE {_CYCLIC},
        reach AS (SELECT graph, src, dst FROM e
                  UNION SELECT r.graph, r.src, e.dst FROM reach r JOIN e ON r.graph = e.graph AND r.dst = e.src),
        n AS (SELECT graph, src AS node FROM e UNION SELECT graph, dst FROM e),
        mutual AS (SELECT a.graph, a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.graph = b.graph AND a.src = b.dst AND a.dst = b.src),
        c AS (SELECT n.graph, n.node, least(n.node, coalesce(min(mutual.other), n.node)) AS component, count(mutual.other) > 0 AS cyc
              FROM n LEFT JOIN mutual ON n.graph = mutual.graph AND n.node = mutual.node GROUP BY n.graph, n.node)
        SELECT graph, component, count(*) AS nodes, bool_or(cyc) AS is_cycle FROM c GROUP BY graph, component""",
)
def dag_components(t):
    return graph.components(cyclic_edges(t))


@query(
    "dag_levels",
    """WITH RECURSIVE e AS (SELECT graph, src, dst FROM acyclic_edges
                            UNION SELECT a.graph, a.src, a.src + 3 FROM acyclic_edges a
                            JOIN acyclic_nodes n ON n.graph = a.graph AND n.node = a.src + 3 WHERE n.type = 'assistant'),
       walk AS (SELECT graph, node, 0 AS level FROM acyclic_nodes
                WHERE (graph, node) NOT IN (SELECT graph, dst FROM e)
                UNION SELECT w.graph, e.dst, w.level + 1 FROM walk w JOIN e ON w.graph = e.graph AND w.node = e.src)
       SELECT graph, node, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY graph, node""",
)
def dag_levels(t):
    ends = t.acyclic_nodes.where(F.col("type") == "assistant").select("graph", F.col("node").alias("dst"))
    shortcuts = (
        t.acyclic_edges.select("graph", "src", (F.col("src") + 3).alias("dst")).join(ends, ["graph", "dst"], "left_semi")
    )
    return graph.topological_levels(t.acyclic_nodes, t.acyclic_edges.unionByName(shortcuts))


@query(
    "exec_settings",
    """SELECT p_partkey, CASE WHEN p_size = 5 THEN 1 ELSE p_size - 5 END AS parallelism, p_size % 7 - 2 AS max_retries,
              concat_ws('; ', CASE WHEN p_size < 5 THEN 'execution.parallelism: parallelism must be non-negative' END,
                  CASE WHEN p_size % 7 < 2 THEN 'execution.retryPolicy.maxRetries: maxRetries must be non-negative' END) AS errors
       FROM part""",
)
def exec_settings(t):
    settings = t.part.select(
        "p_partkey", (F.col("p_size") - 5).alias("parallelism"), (F.col("p_size") % 7 - 2).alias("max_retries")
    )
    return validation.check_settings(settings).withColumn("errors", issues_text(F.col("errors")))


@query(
    "function_defs",
    """SELECT id, name, type <> 'SMALL' AS valid, CASE WHEN type = 'SMALL' THEN 'Input type is required' ELSE '' END AS errors,
              CASE WHEN version > 40 THEN 'Output type is not specified' ELSE '' END AS warnings FROM functions""",
)
def function_defs(t):
    defined = t.functions.select(
        "id",
        "name",
        F.when(F.col("type") != "SMALL", F.col("type")).otherwise("").alias("input_type"),
        F.when(F.col("version") <= 40, F.col("type")).alias("output_type"),
    )
    return validation.check_function_types(defined).drop("input_type", "output_type")


@query(
    "dlq_route",
    f"""WITH bad AS (SELECT *, {_RULES} AS error,
                            TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts FROM records)
        SELECT lang AS queue, doc_id AS id, source, error, ts AS "timestamp", ts AS enqueued_at, 0 AS retry_count,
               strlen(text) AS text_bytes,
               row_number() OVER (PARTITION BY lang ORDER BY ts, doc_id) AS position,
               row_number() OVER (PARTITION BY lang ORDER BY ts, doc_id) <= 100 AS accepted
        FROM bad WHERE error <> ''""",
)
def dlq_route(t):
    joined = join_labels(t, checked_documents(t, "text", "lang", "source"))
    errors = validation.chain(F.col("text_errors"), label_errors(t))
    bad = joined.withColumn("error", issues_text(errors)).where(F.col("error") != "").drop("text_errors")
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).cast("timestamp_ntz")
    messages = quarantine.to_messages(bad, "doc_id", F.col("lang"), F.col("source"), F.col("error"), stamp)
    admitted = quarantine.admit(messages, ordering.time_slice("timestamp", "day"), capacity=100)
    size = F.octet_length(F.get_json_object("payload", "$.text")).cast("bigint")
    return admitted.withColumn("text_bytes", size).drop("payload")


@query(
    "dlq_requeue",
    """WITH asked AS (SELECT doc_id FROM labels WHERE toxic = 1)
       SELECT id, queue, payload, CASE WHEN id IN (SELECT doc_id FROM asked) THEN NULL ELSE error END AS error,
              CASE WHEN id IN (SELECT doc_id FROM asked) THEN TIMESTAMP '2024-06-01 00:00:00' ELSE "timestamp" END AS "timestamp",
              enqueued_at, retry_count + CAST(id IN (SELECT doc_id FROM asked) AS INTEGER) AS retry_count
       FROM dead_letters""",
)
def dlq_requeue(t):
    asked = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return quarantine.requeue(t.dead_letters, asked, "2024-06-01 00:00:00")


@query(
    "dlq_requeue_unknown",
    """SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT id FROM dead_letters)""",
)
def dlq_requeue_unknown(t):
    asked = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return quarantine.unknown_ids(t.dead_letters, asked)


@query(
    "dlq_remove",
    "SELECT id, queue, payload FROM dead_letters WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
)
def dlq_remove(t):
    asked = t.labels.where(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return quarantine.remove(t.dead_letters, asked).select("id", "queue", "payload")


@query(
    "dlq_clear",
    """SELECT id, queue, payload FROM dead_letters WHERE queue NOT IN
       (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def dlq_clear(t):
    queues = t.records.where(F.col("toxic") == 1).select(F.col("source").alias("queue"))
    return quarantine.clear(t.dead_letters, queues).select("id", "queue", "payload")


@query(
    "dlq_list",
    """SELECT id, queue, CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE error END AS error,
              enqueued_at FROM dead_letters ORDER BY enqueued_at, id LIMIT 50 OFFSET 10""",
)
def dlq_list(t):
    asked = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    requeued = quarantine.requeue(t.dead_letters.drop("payload"), asked, "2024-06-01 00:00:00")
    return quarantine.peek(requeued.select("id", "queue", "error", "enqueued_at"), 10, 50)


@query(
    "dlq_stats",
    """SELECT queue, count(*) AS size, count(*) / 25 * 100 AS usage_percent, count(*) / 25 * 100 > 80 AS near_capacity,
              count(*) >= 25 AS "full" FROM dead_letters GROUP BY queue""",
)
def dlq_stats(t):
    return quarantine.stats(t.dead_letters, capacity=25)


@query(
    "dlq_preview",
    """SELECT id, 'ID: ' || id || ', Payload: ' || CASE WHEN length(payload) > 100 THEN substring(payload, 1, 100) || '...'
              ELSE payload END || ', Error: ' || error AS line FROM dead_letters""",
)
def dlq_preview(t):
    return quarantine.preview(t.dead_letters)


@query(
    "dlq_retention",
    """SELECT id, queue, "timestamp" FROM dead_letters WHERE "timestamp" >= TIMESTAMP '2024-01-08 06:00:00' - INTERVAL 7 DAY""",
)
def dlq_retention(t):
    path = scratch(t.spark, "quarantine")
    quarantine.store(t.dead_letters, path)
    return quarantine.retained(t.spark.read.parquet(path), "2024-01-08 06:00:00").select("id", "queue", "timestamp")
