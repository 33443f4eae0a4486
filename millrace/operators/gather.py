"""Putting results of shards back together.

Results stay rows. Nothing is collected into one value, except per-shard totals, whose number is the
number of shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordering


def completed(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "completed")


def merge(results: DataFrame, result: str, order_by: Sequence[str]) -> DataFrame:
    """Union of the result maps of completed tasks as ``(key, value)`` rows; the last task wins a key."""
    entries = completed(results).select(*order_by, F.explode(result).alias("key", "value"))
    return entries.groupBy("key").agg(F.max_by("value", F.struct(*order_by)).alias("value"))


def concat(results: DataFrame, order_by: Sequence[str], slice_by: Column) -> DataFrame:
    """Completed results in shard order, each with its place in the whole."""
    return ordering.numbered(completed(results), [F.col(c) for c in order_by], slice_by)


def reduce(results: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Reduce completed results with Spark aggregates, such as ``total=F.sum("value")``."""
    return completed(results).groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])


def fold(df: DataFrame, keys: Sequence[str], steps: Mapping[str, Callable], spread: int = 64) -> DataFrame:
    """Reduce columns per group with associative functions of two values, such as ``math.gcd``.

    The functions must be commutative too, as rows of a group come in any order. A numpy ufunc is used as it
    is. Every Arrow batch is reduced before the shuffle. The batches of a group are then reduced in up to
    ``spread`` tasks, so that its last task gets no more than ``spread`` rows of it, however hot it is. Rows
    of a group come sorted in batches and only the running value of one group is carried between them, so
    neither a hot group nor many groups need memory.
    """
    names = list(keys)
    schema = df.select(*names, *steps).schema

    def squeeze(batch: pd.DataFrame) -> pd.DataFrame:
        """One row per group of a batch, groups in the order of their first row."""
        group = batch.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        out = batch[names].iloc[order[starts]].reset_index(drop=True)
        for column, step in steps.items():
            function = step if isinstance(step, np.ufunc) else np.frompyfunc(step, 2, 1)
            out[column] = function.reduceat(batch[column].to_numpy()[order], starts)
        return out

    def by_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield squeeze(batch)

    def by_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            if len(batch):
                done = squeeze(batch if tail is None else pd.concat([tail, batch], ignore_index=True))
                tail = done.iloc[-1:]
                yield done.iloc[:-1]
        if tail is not None:
            yield tail

    def reduced(rows: DataFrame, *salt: str) -> DataFrame:
        by_group = rows.repartition(*names, *salt).sortWithinPartitions(*names)
        return by_group.select(*names, *steps).mapInPandas(by_run, schema)

    partial = df.select(*names, *steps).mapInPandas(by_batch, schema)
    salted = partial.withColumn("__salt", F.spark_partition_id() % F.lit(spread))
    return reduced(reduced(salted, "__salt"))


def ordered(results: DataFrame, value: Column, shard: str = "shard_id") -> DataFrame:
    """One total per shard, gathered into an array in shard order."""
    totals = completed(results).groupBy(shard).agg(value.alias("__value"))
    pairs = F.array_sort(F.collect_list(F.struct(shard, "__value")))
    return totals.agg(F.transform(pairs, lambda p: p["__value"]).alias("values"))


def gather(results: DataFrame, how: str = "merge", **settings) -> DataFrame:
    """Aggregator by name; an unknown name merges."""
    if how == "concat":
        return concat(results, settings["order_by"], settings["slice_by"])
    if how == "reduce":
        return reduce(results, settings.get("keys", ()), **settings["aggregates"])
    return merge(results, settings["result"], settings["order_by"])


def collector(inputs: DataFrame, key: str) -> DataFrame:
    """Every input as one row, and one row with the number of processed inputs."""
    rows = inputs.select(
        F.lit("result").alias("kind"),
        F.col(key).alias("key"),
        F.to_json(F.struct(*inputs.columns)).alias("result"),
        F.lit(None).cast("bigint").alias("processed_count"),
    )
    total = inputs.agg(F.count(F.lit(1)).alias("processed_count")).select(
        F.lit("summary").alias("kind"),
        F.lit(None).cast(inputs.schema[key].dataType).alias("key"),
        F.lit(None).cast("string").alias("result"),
        "processed_count",
    )
    return rows.unionByName(total)
