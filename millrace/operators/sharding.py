"""Shard ids and shard layouts."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.encode import fnv1a_mod
from millrace.operators import ordering


@dataclass(frozen=True)
class ShardSpec:
    """How to shard: ``hash``, ``range``, ``round_robin`` or ``ring``; any other strategy means hash. ``order_by`` and
    ``slice_by`` serve round robin, ``bounds`` range, ``virtual_nodes`` ring; ``consistent`` makes a ring of hash."""

    shards: int
    strategy: str = "hash"
    key: str = "key"
    bounds: Sequence[str] = field(default_factory=tuple)
    order_by: Sequence[str] = field(default_factory=tuple)
    slice_by: Column | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    consistent: bool = False
    virtual_nodes: int = 64


def hash_shard(key: Column, shards: int) -> Column:
    """64-bit FNV-1a of the key modulo the number of shards; fewer than one shard means one."""
    return fnv1a_mod(key.cast("string"), max(shards, 1)).cast("int")


def range_shard(key: Column, bounds: Sequence[str], shards: int) -> Column:
    """Index of the first bound above the key, modulo the shards; without bounds the hash shard."""
    shards = max(shards, 1)
    if not bounds:
        return hash_shard(key, shards)
    placed = None
    for i, bound in enumerate(bounds):
        shard = F.lit(i % shards)
        placed = F.when(key < bound, shard) if placed is None else placed.when(key < bound, shard)
    return placed.otherwise(F.lit(len(bounds) % shards))


def _ring_hash(text: Column) -> Column:
    """The first 60 bits of the MD5, a number below 2^60."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Places of the virtual nodes ``shard#number`` on the ring, in order, each with its shard."""
    names = [(f"{s}#{v}", s) for s in range(max(shards, 1)) for v in range(max(virtual_nodes, 1))]
    return sorted((int(hashlib.md5(name.encode()).hexdigest()[:15], 16), s) for name, s in names)


def ring_shard(key: Column, shards: int, virtual_nodes: int = 64) -> Column:
    """Shard of the first virtual node at or after the key's place on the ring, past the last one the first.

    When a shard is added only keys that it takes over move, about one in ``shards + 1``. The ring is a constant of
    the plan, searched by bisection; its size is the number of virtual nodes. A null key has no shard.
    """
    nodes = ring(shards, virtual_nodes)
    places, owners = (F.split(F.lit(",".join(str(n[k]) for n in nodes)), ",").cast("array<long>") for k in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(nodes).bit_length()))])

    def search(place: Column) -> Column:
        """How many virtual nodes lie before the place."""
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(places, at + step - 1) < place, step).otherwise(0))

    found = F.transform(F.array(_ring_hash(key)), lambda place: F.get(owners, search(place) % len(nodes)).cast("int"))
    return F.when(key.isNotNull(), F.get(found, F.lit(0)))


def shard(df: DataFrame, spec: ShardSpec) -> DataFrame:
    """Add ``shard_id``, and ``shard_meta`` when the settings carry metadata."""
    shards = max(spec.shards, 1)
    if spec.strategy == "round_robin":
        if spec.slice_by is None or not spec.order_by:
            raise ValueError("round robin needs an order and a slice of it")
        numbered = ordering.numbered(df, [F.col(c) for c in spec.order_by], spec.slice_by, out="__position")
        out = numbered.withColumn("shard_id", ((F.col("__position") - 1) % shards).cast("int")).drop("__position")
    elif spec.strategy == "range":
        out = df.withColumn("shard_id", range_shard(F.col(spec.key), spec.bounds, shards))
    elif spec.strategy == "ring" or spec.consistent:
        out = df.withColumn("shard_id", ring_shard(F.col(spec.key), shards, spec.virtual_nodes))
    else:
        out = df.withColumn("shard_id", hash_shard(F.col(spec.key), shards))
    if spec.metadata:
        pairs = [F.lit(x) for pair in spec.metadata.items() for x in pair]
        out = out.withColumn("shard_meta", F.create_map(*pairs))
    return out


def lay_out(sharded: DataFrame, shards: int, parts: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Place rows of a shard together. A hot shard is spread over ``parts`` tasks by a hash of ``within``."""
    if parts <= 1:
        return sharded.repartition(shards, "shard_id")
    hashable = [f.name for f in sharded.schema if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*(within or hashable)), F.lit(parts))
    return sharded.repartition(shards * parts, F.col("shard_id"), salt)


def balance(sharded: DataFrame, shards: int, tolerance: float = 0.5) -> DataFrame:
    """Rows per shard, empty shards included; a shard below the tolerated share of the mean is flagged."""
    counts = sharded.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    every = sharded.sparkSession.range(max(shards, 1)).select(F.col("id").cast("int").alias("shard_id"))
    filled = every.join(counts, "shard_id", "left").select("shard_id", F.coalesce("n", F.lit(0)).alias("rows"))
    # One row per shard: the window without keys is as small as the number of shards.
    mean = F.avg("rows").over(Window.partitionBy())
    return filled.withColumn("mean_rows", mean).withColumn("under_filled", F.col("rows") < F.col("mean_rows") * tolerance)
