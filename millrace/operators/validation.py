"""Rule-based validation of records as error arrays built from column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.encode import checksum
from millrace.functions.values import to_float
from millrace.sources.records import ingest

ISSUE = "array<struct<field:string,message:string>>"

# Type names of a rule, each with the kinds of JSON value that fit besides whole floats.
TYPE_NAMES = {
    "string": "string", "int": "integer", "integer": "integer", "float": "float", "double": "float",
    "bool": "boolean", "boolean": "boolean", "array": "array", "slice": "array", "object": "object",
    "map": "object", "null": "null", "nil": "null",
}


@dataclass(frozen=True)
class FieldRule:
    """What one field must satisfy. ``custom`` maps the value column to a message column, null when fine."""

    field: str
    required: bool = False
    type: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    enum: Sequence[object] = ()
    custom: Callable[[Column], Column] | None = None


def issue(field: str, message: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"))


def _kind_of(simple: str) -> str:
    """Rule type name that a Spark type stands for."""
    head = simple.split("(")[0].split("<")[0]
    return {
        "string": "string", "boolean": "boolean", "double": "float", "float": "float", "decimal": "float",
        "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "array": "array",
        "struct": "object", "map": "object", "void": "null",
    }.get(head, head)


def type_fits(value: Column, simple: str, wanted: str) -> Column:
    """Whether a value of a Spark type fits a rule type."""
    kind, want = _kind_of(simple), TYPE_NAMES.get(wanted, wanted)
    if want == "integer" and kind == "float":
        return F.floor(value) == value
    if want == "float":
        if kind == "string":
            return to_float(value).isNotNull()
        return F.lit(kind in ("integer", "float"))
    return F.lit(kind == want)


def json_kind(document: Column, path: str) -> Column:
    """Kind of the value inside JSON text: one of the rule types, ``whole`` for a float without a fraction
    and ``numeral`` for a string that reads as a number; null when it is missing or null."""
    value = F.try_variant_get(F.try_parse_json(document), path, "variant")
    head = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    text = F.get_json_object(document, path)
    number = text.try_cast("double")
    return (
        F.when(head == "BIGINT", "integer")
        .when(head.isin("DOUBLE", "DECIMAL"), F.when(F.floor(number) == number, "whole").otherwise("float"))
        .when(head == "STRING", F.when(to_float(text).isNotNull(), "numeral").otherwise("string"))
        .when(head == "BOOLEAN", "boolean")
        .when(head == "ARRAY", "array")
        .when(head == "OBJECT", "object")
    )


# Kinds of JSON value that satisfy each rule type.
KINDS_OF_TYPE = {
    "string": ("string", "numeral"),
    "integer": ("integer", "whole"),
    "float": ("integer", "whole", "float", "numeral"),
    "boolean": ("boolean",),
    "array": ("array",),
    "object": ("object",),
}


def kind_fits(kind: Column, wanted: str) -> Column:
    """Whether a kind satisfies a rule type; a missing or null value satisfies only ``null``."""
    want = TYPE_NAMES.get(wanted, wanted)
    if want == "null":
        return kind.isNull()
    return F.coalesce(kind.isin(*KINDS_OF_TYPE.get(want, ("",))), F.lit(False))


def field_issue(rule: FieldRule, value: Column, simple: str) -> Column:
    """First failing check of a field as a struct, null when the field is fine."""
    kind = _kind_of(simple)
    checks: list[tuple[Column, Column]] = []

    def check(fails: Column, message: Column | str) -> None:
        checks.append((fails, F.lit(message) if isinstance(message, str) else message))

    if rule.type:
        check(~type_fits(value, simple, rule.type), f"expected type {rule.type}")
    if kind == "string":
        if rule.min_length is not None:
            check(F.octet_length(value) < rule.min_length, f"length must be at least {rule.min_length}")
        if rule.max_length is not None:
            check(F.octet_length(value) > rule.max_length, f"length must be at most {rule.max_length}")
    number = {"string": to_float(value), "integer": value.cast("double"), "float": value.cast("double")}.get(kind) \
        if kind in ("string", "integer", "float") else None
    if number is not None:
        if rule.min_value is not None:
            check(number < rule.min_value, f"value must be at least {rule.min_value:f}")
        if rule.max_value is not None:
            check(number > rule.max_value, f"value must be at most {rule.max_value:f}")
    if rule.pattern is not None and kind == "string":
        check(~value.rlike(rule.pattern), "value does not match pattern")
    if rule.enum:
        allowed = [str(e) for e in rule.enum]
        check(~value.cast("string").isin(*allowed), f"value must be one of [{' '.join(allowed)}]")

    found = F.when(value.isNull(), F.lit("required field is missing") if rule.required else F.lit(None).cast("string"))
    for fails, message in checks:
        found = found.when(fails, message)
    if rule.custom is not None:
        found = found.otherwise(rule.custom(value))
    return F.when(found.isNotNull(), issue(rule.field, found))


def rule_errors(schema: StructType, rules: Sequence[FieldRule], prefix: str = "") -> Column:
    """Errors of a record as an array; rules for fields outside the schema are not looked at."""
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    found = [
        field_issue(r, F.col(f"{prefix}{r.field}"), kinds[r.field]) for r in rules if r.field in kinds
    ]
    if not found:
        return F.array().cast(ISSUE)
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def no_issues() -> Column:
    return F.array().cast(ISSUE)


def validate(df: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    """Add ``errors`` and ``valid``; a record is valid when it has no errors."""
    return df.withColumn("errors", rule_errors(df.schema, rules)).withColumn("valid", F.size("errors") == 0)


def validate_json(df: DataFrame, column: str, schema: str, rules: Sequence[FieldRule]) -> DataFrame:
    """Validate JSON text: text that does not parse is one error, parsed records go through the rules."""
    parsed = ingest(df, column, schema, "record")
    failed = F.array(issue("json", F.lit("failed to parse JSON")))
    errors = F.when(F.col("malformed"), failed).otherwise(
        rule_errors(StructType.fromDDL(schema), rules, prefix="record.")
    )
    return parsed.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def validate_checksum(df: DataFrame, column: str, algorithm: str, expected: str | None = None) -> DataFrame:
    """Add the checksum and byte size of a column and, with ``expected``, whether they agree ignoring case."""
    out = df.withColumn("checksum", checksum(F.col(column), algorithm)).withColumn(
        "input_size", F.octet_length(column)
    )
    if expected is None:
        return out
    return out.withColumn("valid", F.lower("checksum") == F.lower(F.col(expected)))


def chain(*steps: Column) -> Column:
    """Errors of every validator, in order."""
    return F.flatten(F.array(*steps)) if steps else no_issues()


def chain_until_invalid(*steps: Column) -> Column:
    """Errors of the first validator that finds any."""
    return reduce(lambda rest, step: F.when(F.size(step) > 0, step).otherwise(rest), reversed(steps), no_issues())


def merge_results(first: str, second: str) -> Column:
    """Merge two result structs ``<valid, errors, warnings, metadata, duration_ms>`` of one row."""
    a, b = F.col(first), F.col(second)
    kept = F.map_filter(a["metadata"], lambda k, _: ~F.map_contains_key(b["metadata"], k))
    return F.struct(
        (a["valid"] & b["valid"]).alias("valid"),
        F.concat(a["errors"], b["errors"]).alias("errors"),
        F.concat(a["warnings"], b["warnings"]).alias("warnings"),
        F.map_concat(kept, b["metadata"]).alias("metadata"),
        (a["duration_ms"] + b["duration_ms"]).alias("duration_ms"),
    )


def issues_text(issues: Column) -> Column:
    return F.array_join(F.transform(issues, lambda e: F.concat_ws(": ", e["field"], e["message"])), "; ")


def node_problems(definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Definitions without nodes, nodes with blank parts and ids used twice.

    ``definitions(graph)``, ``nodes(graph, node, type, function)``.
    """

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""

    empty = (
        definitions.select("graph")
        .join(nodes.select("graph").distinct(), "graph", "left_anti")
        .select("graph", F.lit("").alias("node"), F.lit("no nodes").alias("problem"))
    )
    checks = F.array(
        F.when(blank("node"), "node id is required"),
        F.when(blank("type"), "node type is required"),
        F.when(blank("function"), "node function is required"),
    )
    parts = nodes.select("graph", F.coalesce("node", F.lit("")).alias("node"), F.explode(checks).alias("problem"))
    twice = (
        nodes.where(~blank("node"))
        .groupBy("graph", "node")
        .agg(F.count(F.lit(1)).alias("uses"))
        .where(F.col("uses") > 1)
        .select("graph", "node", F.lit("duplicate node id").alias("problem"))
    )
    return empty.unionByName(parts.where(F.col("problem").isNotNull())).unionByName(twice)


def check_settings(df: DataFrame) -> DataFrame:
    """Execution settings ``parallelism`` and ``max_retries``: negative is an error, parallelism 0 means 1."""
    problems = F.array(
        F.when(F.col("parallelism") < 0, issue("execution.parallelism", F.lit("parallelism must be non-negative"))),
        F.when(F.col("max_retries") < 0, issue("execution.retryPolicy.maxRetries", F.lit("maxRetries must be non-negative"))),
    )
    effective = F.when(F.col("parallelism") == 0, 1).otherwise(F.col("parallelism"))
    return df.withColumn("errors", F.filter(problems, lambda e: e.isNotNull())).withColumn("parallelism", effective)


def check_function_types(df: DataFrame) -> DataFrame:
    """Function definitions: a missing input type is an error, a missing output type a warning."""
    empty_input = F.coalesce(F.col("input_type"), F.lit("")) == ""
    empty_output = F.coalesce(F.col("output_type"), F.lit("")) == ""
    return df.withColumns(
        {
            "valid": ~empty_input,
            "errors": F.when(empty_input, "Input type is required").otherwise(""),
            "warnings": F.when(empty_output, "Output type is not specified").otherwise(""),
        }
    )
