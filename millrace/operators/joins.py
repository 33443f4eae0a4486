"""Joins, lookups, upserts and deletions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The join kinds of a join node.
JOIN_KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def join_node(left: DataFrame, right: DataFrame, on, how: str = "inner", hint: str | None = None) -> DataFrame:
    """A join by key names or by predicate. ``hint`` is handed to Spark (``merge``, ``shuffle_hash``)."""
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}")
    return left.join(right.hint(hint) if hint else right, on, how)


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Every parent with each of its children, one row per pair; parents without children are kept.

    Written as inner join plus anti join: both sides of an inner join may be split when one parent owns a
    large share of the children, which an outer join forbids on its inner side.
    """
    pairs = parents.join(children, parents[parent_key] == children[child_key], "inner")
    childless = parents.join(
        children.select(F.col(child_key).alias("__key")).distinct(),
        parents[parent_key] == F.col("__key"),
        "left_anti",
    )
    return pairs.unionByName(childless, allowMissingColumns=True)


def existing_keys(df: DataFrame, requested: DataFrame, on: Sequence[str]) -> DataFrame:
    """Requested keys with a flag saying whether the table holds them."""
    known = df.select(*on).distinct().withColumn("__known", F.lit(True))
    found = F.coalesce(F.col("__known"), F.lit(False)).alias("found")
    return requested.join(known, list(on), "left").select(*requested.columns, found)


def without_keys(df: DataFrame, keys: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Delete rows whose key is listed."""
    listed = keys.select(F.col(right_key).alias("__key")).distinct()
    return df.join(listed, df[left_key] == F.col("__key"), "left_anti")


def rollback(current: DataFrame, requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Set pipelines back to a requested version; a request for an unknown version is flagged.

    ``current(id, definition, version)``, ``requests(pipeline_id, version)``,
    ``versions(pipeline_id, version, definition)``.
    """
    target = requests.select(F.col("pipeline_id").alias("id"), F.col("version").alias("__wanted"))
    stored = versions.select(
        F.col("pipeline_id").alias("id"),
        F.col("version").alias("__wanted"),
        F.col("definition").alias("__stored"),
        F.lit(True).alias("__hit"),
    )
    wanted = target.join(stored, ["id", "__wanted"], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    outcome = F.when(hit, "rolled_back").when(F.col("__wanted").isNotNull(), "version_missing").otherwise("unchanged")
    return current.join(wanted, "id", "left").select(
        "id",
        F.when(hit, F.col("__stored")).otherwise(F.col("definition")).alias("definition"),
        F.when(hit, F.col("__wanted")).otherwise(F.col("version")).alias("version"),
        outcome.alias("outcome"),
    )


def upsert_partial(current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Merge by key: a non-empty incoming field replaces the stored one, an empty one keeps it."""
    new = incoming.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__new"))
    old = current.select(key, *fields).withColumn("__old", F.lit(True))
    merged = old.join(new, key, "full")
    action = (
        F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "kept").otherwise("updated")
    )
    return merged.select(
        key,
        *[F.coalesce(F.nullif(F.col(f"__{f}"), F.lit("")), F.col(f)).alias(f) for f in fields],
        action.alias("action"),
    )


def reconcile_checksums(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Compare ``checksum`` columns by key, ignoring case, and report sides that are missing.

    Other columns of ``actual``, such as a size, are kept. Drop contents before: only digests need to meet.
    """
    extra = [c for c in actual.columns if c not in (key, "checksum")]
    a = actual.select(key, F.lower("checksum").alias("actual"), *extra)
    e = expected.select(key, F.lower("checksum").alias("expected"))
    verdict = (
        F.when(F.col("expected").isNull(), "unexpected")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("expected"), "match")
        .otherwise("mismatch")
    )
    return a.join(e, key, "full").select(key, "actual", "expected", verdict.alias("verdict"), *extra)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that name no node, and edges from a node to itself.

    ``nodes(graph, node)``, ``edges(graph, src, dst)``.
    """
    known = nodes.select("graph", F.col("node").alias("__node")).distinct()

    def missing(end: str, problem: str) -> DataFrame:
        ends = edges.select("graph", "src", "dst", F.col(end).alias("__node"))
        return ends.join(known, ["graph", "__node"], "left_anti").select(
            "graph", "src", "dst", F.lit(problem).alias("problem")
        )

    loops = edges.where(F.col("src") == F.col("dst")).select(
        "graph", "src", "dst", F.lit("self_edge").alias("problem")
    )
    return missing("src", "unknown_source").unionByName(missing("dst", "unknown_target")).unionByName(loops)


def lookup_chain(tasks: DataFrame, executions: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Task with its execution and that execution's pipeline."""
    run = executions.select(F.col("id").alias("execution_id"), "pipeline_id")
    owner = pipelines.select(
        F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"), F.col("status").alias("pipeline_status")
    )
    return tasks.join(run.join(owner, "pipeline_id"), "execution_id")


def keep(df: DataFrame, condition: Column, keep_matches: bool = True) -> DataFrame:
    """Filter node: a null condition counts as no match, so the two settings split the input."""
    matched = F.coalesce(condition, F.lit(False))
    return df.where(matched if keep_matches else ~matched)
