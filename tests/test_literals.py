"""Small literal inputs with known answers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import encode, text, values
from millrace.operators import errors, gather, graph, joins, logs, metrics, ordering, quality, quarantine, runs
from millrace.operators import sharding, transforms, validation
from millrace.operators.validation import FieldRule
from millrace.sources import records, sinks


def one(df):
    return df.collect()[0]


def first_error(spark, rows, schema, *rules):
    row = one(validation.validate(spark.createDataFrame(rows, schema), rules))
    return None if row["valid"] else (row["errors"][0]["field"], row["errors"][0]["message"])


@pytest.mark.parametrize(
    "value, kind, rule, message",
    [
        ("test", "string", FieldRule("v", required=True), None),
        (None, "string", FieldRule("v", required=True, min_length=1), "required field is missing"),
        (None, "string", FieldRule("v", min_length=1), None),
        (123, "bigint", FieldRule("v", type="string"), "expected type string"),
        (25.0, "double", FieldRule("v", type="int"), None),
        (25.5, "double", FieldRule("v", type="int"), "expected type int"),
        ("25.5", "string", FieldRule("v", type="float"), None),
        ("abc", "string", FieldRule("v", type="float"), "expected type float"),
        ("ab", "string", FieldRule("v", min_length=5), "length must be at least 5"),
        ("abcdef", "string", FieldRule("v", max_length=5), "length must be at most 5"),
        (-5, "bigint", FieldRule("v", min_value=0), "value must be at least 0.000000"),
        (150.0, "double", FieldRule("v", max_value=100), "value must be at most 100.000000"),
        ("7", "string", FieldRule("v", min_value=10), "value must be at least 10.000000"),
        ("invalid-email", "string", FieldRule("v", pattern="^[^@]+@[^@]+$"), "value does not match pattern"),
        ("unknown", "string", FieldRule("v", enum=("active", "inactive", "pending")), "value must be one of [active inactive pending]"),
        (True, "boolean", FieldRule("v", type="bool"), None),
        ([1], "array<int>", FieldRule("v", type="array"), None),
        ({"a": 1}, "map<string,int>", FieldRule("v", type="object"), None),
    ],
)
def test_field_rules(spark, value, kind, rule, message):
    found = first_error(spark, [(value,)], f"v {kind}", rule)
    assert found == (None if message is None else ("v", message))


def test_rules_outside_the_schema_are_ignored(spark):
    assert first_error(spark, [("a",)], "v string", FieldRule("w", required=True)) is None


def test_json_record(spark):
    df = spark.createDataFrame([('{"name": "test", "age": 25}',), ('{"name": ',), (None,)], "raw string")
    rules = [FieldRule("name", required=True), FieldRule("age", type="int")]
    rows = validation.validate_json(df, "raw", "name STRING, age BIGINT", rules).collect()
    assert [r["valid"] for r in rows] == [True, False, False]
    assert rows[1]["errors"][0]["field"] == "json"


def test_checksums(spark):
    df = spark.createDataFrame([("hello world",)], "data string")
    for name, fn in (("md5", hashlib.md5), ("sha1", hashlib.sha1), ("sha256", hashlib.sha256)):
        row = one(validation.validate_checksum(df, "data", name))
        assert (row["checksum"], row["input_size"]) == (fn(b"hello world").hexdigest(), 11)
    with pytest.raises(ValueError):
        encode.checksum(F.lit("x"), "crc32")


def test_quality_of_two_rows(spark):
    df = spark.createDataFrame([("alice", 30), ("bob", None)], "name string, age bigint")
    row = one(quality.verdict(quality.scores(df, ["name", "age"])))
    assert (row["completeness"], row["null_percent"], row["accuracy"]) == (0.75, 0.25, 1.0)
    assert [e["message"] for e in row["errors"]] == ["completeness 0.75 is below threshold 0.80"]
    assert [w["message"] for w in row["warnings"]] == ["null percent 0.25 exceeds threshold 0.10"]


def test_quality_of_broken_and_of_no_rows(spark):
    df = spark.createDataFrame([("", 1.0), ("a", float("nan")), ("b", float("inf")), ("c", None)], "s string, x double")
    assert one(quality.scores(df, ["s", "x"]))["accuracy"] == 0.25
    empty = one(quality.verdict(quality.scores(df.where("false"), ["s", "x"])))
    assert not empty["valid"] and empty["errors"][0]["message"] == "data is empty"


def test_merging_results(spark):
    issues = "array<struct<field:string,message:string>>"
    kind = f"struct<valid:boolean,errors:{issues},warnings:{issues},metadata:map<string,string>,duration_ms:int>"
    a = (True, [("x", "1")], [], {"k": "a", "j": "a"}, 2)
    b = (False, [("y", "2")], [("z", "3")], {"k": "b"}, 3)
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    m = one(df.select(validation.merge_results("a", "b").alias("m")))["m"]
    assert (len(m["errors"]), len(m["warnings"]), m["valid"], m["duration_ms"]) == (2, 1, False, 5)
    assert m["metadata"] == {"k": "b", "j": "a"}


def test_hash_vectors(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "k string").select(encode.fnv1a_hex(F.col("k")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


@pytest.mark.parametrize("n", [0, -5, 1])
def test_too_few_shards_mean_one(spark, n):
    df = spark.createDataFrame([("test-key",), ("",)], "key string")
    assert {r["shard_id"] for r in sharding.shard(df, sharding.ShardSpec(n)).collect()} == {0}


def test_alphabet_uses_several_shards(spark):
    df = spark.createDataFrame([(chr(c),) for c in range(97, 123)], "key string")
    ids = [r["shard_id"] for r in sharding.shard(df, sharding.ShardSpec(4)).collect()]
    assert len(set(ids)) >= 2 and all(0 <= i < 4 for i in ids)


def test_round_robin(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "id bigint")
    spec = sharding.ShardSpec(3, "round_robin", order_by=("id",), slice_by=ordering.id_slice("id", 2))
    assert [r["shard_id"] for r in sharding.shard(df, spec).orderBy("id").collect()] == [0, 1, 2, 0, 1, 2]


def test_range_shards(spark):
    names = ["apple", "banana", "pear", "watermelon", "zucchini"]
    df = spark.createDataFrame([(n,) for n in names], "key string")
    spec = sharding.ShardSpec(3, "range", bounds=("m", "p", "v"))
    assert [r["shard_id"] for r in sharding.shard(df, spec).collect()] == [0, 0, 2, 0, 0]
    unbounded = sharding.shard(df, sharding.ShardSpec(3, "range")).collect()
    assert unbounded == sharding.shard(df, sharding.ShardSpec(3)).collect()


def test_shard_totals(spark):
    df = spark.createDataFrame([(3, 40), (0, 10), (2, 30), (1, 20)], "shard_id int, items bigint").withColumn("status", F.lit("completed"))
    assert one(gather.ordered(df, F.sum("items")))["values"] == [10, 20, 30, 40]
    assert one(gather.gather(df, "reduce", aggregates={"total": F.sum("items")}))["total"] == 100


def levels(spark, nodes, edges):
    n = spark.createDataFrame([("g", x) for x in nodes], "graph string, node string")
    e = spark.createDataFrame([("g", a, b) for a, b in edges], "graph string, src string, dst string")
    return {r["node"]: r["level"] for r in graph.topological_levels(n, e).collect()}, {
        r["node"] for r in graph.cyclic_nodes(e).collect()
    }


def test_diamond(spark):
    assert levels(spark, "ABCD", ["AB", "AC", "BD", "CD"]) == ({"A": 0, "B": 1, "C": 1, "D": 2}, set())


def test_parallel_branches(spark):
    found, cyclic = levels(spark, "SABCE", ["SA", "SB", "AC", "BC", "CE"])
    assert (found, cyclic) == ({"S": 0, "A": 1, "B": 1, "C": 2, "E": 3}, set())


def test_cycle(spark):
    found, cyclic = levels(spark, "ABC", ["AB", "BC", "CA"])
    assert cyclic == set("ABC") and set(found.values()) == {None}


def test_below_and_above_a_cycle(spark):
    found, cyclic = levels(spark, "XABYZ", ["XA", "AB", "BA", "BY"])
    assert cyclic == set("ABY") and (found["X"], found["Z"], found["Y"]) == (0, 0, None)


def test_graph_without_edges(spark):
    nodes = spark.createDataFrame([("g", "A"), ("g", "B")], "graph string, node string")
    edges = spark.createDataFrame([], "graph string, src string, dst string")
    assert {r["node"]: r["level"] for r in graph.topological_levels(nodes, edges).collect()} == {"A": 0, "B": 0}
    assert graph.cyclic_nodes(edges).count() == 0


def test_missing_dependency(spark):
    nodes = spark.createDataFrame([("g", "A"), ("g", "B")], "graph string, node string")
    edges = spark.createDataFrame([("g", "nonexistent", "B"), ("g", "A", "B")], "graph string, src string, dst string")
    row = one(joins.dangling_edges(nodes, edges))
    assert (row["src"], row["problem"]) == ("nonexistent", "unknown_source")


def test_definition_json(spark):
    document = """{"nodes": [{"id": "s", "type": "start"}, {"id": "e", "type": "end"}],
                   "edges": [{"from": "s", "to": "e"}],
                   "execution": {"parallelism": 1, "retryPolicy": {"maxRetries": 3, "backoff": "exponential"}}}"""
    df = spark.createDataFrame([(document,)], "raw string")
    row = one(records.ingest(df, "raw", records.DEFINITION))
    assert (len(row["record"]["nodes"]), len(row["record"]["edges"]), row["malformed"]) == (2, 1, False)
    assert row["record"]["execution"]["retryPolicy"]["maxRetries"] == 3


@pytest.mark.parametrize("schema", [records.DEAD_LETTER, records.FILE_CONTENT, records.DATA_RECORD])
def test_other_record_schemas_parse(spark, schema):
    df = spark.createDataFrame([("{}",), ("{",)], "raw string")
    assert [r["malformed"] for r in records.ingest(df, "raw", schema).collect()] == [False, True]


def test_lifecycle_moves(spark):
    statuses = ("draft", "active", "paused", "stopped")
    pairs = [(a, b) for a in statuses for b in statuses]
    df = spark.createDataFrame(pairs, "a string, b string").where(runs.legal_move(F.col("a"), F.col("b")))
    assert {(r["a"], r["b"]) for r in df.collect()} == set(runs.LEGAL_MOVES)


def test_backoff(spark):
    df = spark.createDataFrame([(n,) for n in (-1, 1, 2, 3, 12)], "n int")
    rows = df.select(
        errors.backoff_delay(F.col("n"), "fixed", 100).alias("fixed"),
        errors.backoff_delay(F.col("n"), "linear", 100, 100, max_ms=1000).alias("linear"),
        errors.backoff_delay(F.col("n"), "anything", 100, max_ms=1000).alias("exponential"),
        errors.total_backoff(F.col("n"), "linear", initial_ms=100, step_ms=100, max_ms=1000).alias("waited"),
    ).collect()
    assert [r["fixed"] for r in rows] == [100] * 5
    assert [r["linear"] for r in rows] == [100, 100, 200, 300, 1000]
    assert [r["exponential"] for r in rows] == [100, 100, 200, 400, 1000]
    assert [r["waited"] for r in rows] == [100, 100, 300, 600, 7500]


def test_retry_accounting(spark):
    df = spark.sql(
        """SELECT 't' AS task, n AS attempt, timestamp_ntz'2024-01-01 00:00:00' AS start_time,
                  timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, n * 0.01) AS end_time
           FROM VALUES (1), (2), (3) v(n)
           UNION ALL SELECT 't', 4, timestamp_ntz'2024-01-01 00:00:01', NULL"""
    )
    row = one(errors.retry_stats(df, "task"))
    assert (row["attempts"], row["total_ms"], row["last_attempt"]) == (4, 60, 4)


def test_error_codes(spark):
    df = spark.createDataFrame([(-1,), (0,), (33,), (46,), (500,)], "n int").select(errors.code_name(F.col("n")).alias("c"))
    classified = df.select("c", errors.code_class(F.col("c")).alias("k")).collect()
    assert [tuple(r) for r in classified] == [
        ("UNKNOWN", "other"), ("UNKNOWN", "other"), ("DATABASE_CONNECTION_FAILED", "retryable"), ("UNAUTHORIZED", "fatal"), ("UNKNOWN", "other"),
    ]


def test_levels_and_thresholds(spark):
    df = spark.createDataFrame([("warning",), ("WARN",), ("Fatal",), ("error",), ("debug",)], "level string")
    assert [r["level"] for r in logs.at_least(df, "warn").collect()] == ["warning", "WARN", "error"]
    assert logs.at_least(df, "no-level").count() == 4


def test_rename_and_sink_arguments(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert transforms.rename(df, "a -> x, b -> y").columns == ["x", "y"]
    for spec in ("a", "a ->", "c -> d"):
        with pytest.raises(ValueError):
            transforms.rename(df, spec)
    for codec in ("gz", "gzip", "lz4", "zstd", "none"):
        assert sinks.codec(codec)
    with pytest.raises(ValueError):
        sinks.codec("brotli")
    with pytest.raises(ValueError):
        sinks.write(df, "/nowhere", batch_size=0)
    with pytest.raises(ValueError):
        joins.join_node(df, df, "a", "sideways")


def test_flatten_deep(spark):
    df = spark.sql("SELECT 1 AS id, struct(2 AS b, struct(3 AS d) AS c) AS a, array(struct(4 AS x), struct(5 AS x)) AS l")
    rows = transforms.flatten(df).orderBy("l_x").collect()
    assert [r.asDict() for r in rows] == [{"id": 1, "a_b": 2, "a_c_d": 3, "l_x": 4}, {"id": 1, "a_b": 2, "a_c_d": 3, "l_x": 5}]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Hello\v ", "HelloWorld", "a.b|c", "")], "s string, c string, p string, e string")
    row = one(
        df.select(
            text.trim_space(F.col("s")).alias("trimmed"),
            text.is_blank(F.col("e")).alias("blank"),
            text.snake_case(F.col("c")).alias("snake"),
            text.kebab_case(F.col("c")).alias("kebab"),
            F.size(text.split_on(F.col("p"), ".")).alias("dots"),
            F.size(text.split_on(F.col("p"), "|")).alias("bars"),
            text.truncate(F.col("c"), 5).alias("cut"),
            text.pad_left(F.col("c"), 3, "*").alias("long"),
            text.contains_any(F.col("p"), "^|]").alias("any"),
            text.is_digit(F.col("e")).alias("digits"),
        )
    )
    assert tuple(row) == ("Hello", True, "hello_world", "hello-world", 2, 2, "Hello...", "HelloWorld", True, True)


def test_number_helpers(spark):
    df = spark.createDataFrame([(2.5, "+7", "x1", "0x1"), (-2.7, " 7", "1e3", "t")], "x double, i string, f string, b string")
    rows = df.select(
        values.round_half_up(F.col("x")).alias("r"),
        values.to_integer(F.col("i")).alias("i"),
        values.to_float(F.col("f")).alias("f"),
        values.to_boolean(F.col("b")).alias("b"),
    ).collect()
    assert [tuple(r) for r in rows] == [(3, 7, None, None), (-2, None, 1000.0, True)]


def test_queue_stats_and_paging(spark):
    df = spark.sql("SELECT 'q' AS queue, id, timestamp_ntz'2024-01-01' AS enqueued_at FROM range(9)")
    row = one(quarantine.stats(df, capacity=10))
    assert (row["size"], row["usage_percent"], row["near_capacity"], row["full"]) == (9, 90.0, True, False)
    assert [r["id"] for r in quarantine.peek(df, -3, 2).collect()] == [0, 1]
    assert quarantine.peek(df, 50, 2).count() == 0
    assert ordering.page(df, [F.col("id")], 0, 0).count() == 9
    assert ordering.page(spark.range(200), [F.col("id")], 0, 500).count() == 200
    with pytest.raises(ValueError):
        quarantine.peek(df, 0, 0)


@pytest.mark.parametrize("width", [1, 2, 10])
def test_gauge_without_set(spark, width):
    rows = [
        ("m", "a", "inc", 2.0, 1), ("m", "a", "dec", 0.5, 2),
        ("m", "b", "inc", 9.0, 1), ("m", "b", "set", 4.0, 2), ("m", "b", "inc", 1.0, 3),
    ]
    df = spark.createDataFrame(rows, "metric string, l string, op string, value double, seq int")
    assert {r["l"]: r["value"] for r in metrics.gauge(df, ["l"], ["seq"], ordering.id_slice("seq", width)).collect()} == {"a": 1.5, "b": 5.0}
