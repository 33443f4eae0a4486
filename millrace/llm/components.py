"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node ties its larger (``large``) or smaller neighbours to its smallest neighbour."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = pairs.join(least, "a")
    tied = tied.where("b > a") if large else tied
    out = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node that has an edge ``a``, ``b`` to another node.

    Large-star and small-star steps alternate until nothing changes, in about log n rounds. Each round is a table in
    the shared folder. Hot nodes are pre-aggregated by ``min``; loops and repeated edges don't matter.
    """
    current = written(edges.select("a", "b").where("a <> b").distinct(), label)
    before = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen.n, seen.x) == before or seen.n == 0:
            break
        before = (seen.n, seen.x)
        current = written(_stars(_stars(current, True), False), label)
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
