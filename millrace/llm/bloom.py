"""Blocked Bloom filters: filled by an aggregation in Spark, broadcast, and probed with numpy inside tasks.

A key sets ``MARKS`` bits of one 64-bit block. Filters come in shards (here: by word length), each a power of two of
blocks; all shards together never hold more than ``MOST`` blocks (32 MB), whatever the number of keys. Beyond
``MOST * 64 / PER_KEY`` keys the filters only get fuller and let more probes through, which an exact join must remove.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of filter for each key, bits set by a key, and blocks of all shards together.
PER_KEY, MARKS, MOST = 32, 5, 1 << 22


def blocks_by_shard(keys: dict[int, int]) -> dict[int, int]:
    """How many blocks each shard gets for its number of keys: a power of two, ``MOST`` or fewer in all."""
    per_key = PER_KEY
    while True:
        blocks = {shard: 1 << max(0, int(n * per_key / 64) - 1).bit_length() for shard, n in keys.items()}
        if sum(blocks.values()) <= max(MOST, len(blocks)):
            return blocks
        per_key /= 2


def _mask(key: Column) -> Column:
    marks = [F.shiftright(key, 6 * k).bitwiseAND(63).cast("int") for k in range(MARKS)]
    out = F.call_function("shiftleft", F.lit(1).cast("long"), marks[0])
    for mark in marks[1:]:
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), mark))
    return out


def filled(keys: DataFrame) -> dict[int, np.ndarray]:
    """The filters of ``keys`` (columns ``shard`` int, ``key`` long), by shard. Blocks meet in map tasks first."""
    counts = {row["shard"]: row["n"] for row in keys.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    blocks = blocks_by_shard(counts)
    last = F.create_map(*[F.lit(x) for shard, n in blocks.items() for x in (shard, n - 1)])
    block = F.shiftrightunsigned("key", 32).bitwiseAND(last[F.col("shard")]).cast("int")
    marked = keys.select("shard", block.alias("block"), _mask(F.col("key")).alias("mask"))
    rows = marked.groupBy("shard", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    shard, at, mask = (rows.column(c).to_numpy() for c in ("shard", "block", "mask"))
    out = {}
    for s, n in blocks.items():
        out[s] = np.zeros(n, np.uint64)
        own = shard == s
        out[s][at[own]] = mask[own].view(np.uint64)
    return out


def holds(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (unsigned 64-bit) a shard may hold; never False for one it does hold."""
    mask = np.zeros(len(keys), np.uint64)
    one = np.uint64(1)
    for k in range(MARKS):
        mask |= one << ((keys >> np.uint64(6 * k)) & np.uint64(63))
    found = blocks[(keys >> np.uint64(32)) & np.uint64(len(blocks) - 1)]
    return (found & mask) == mask
