"""Checks over many pipeline graphs at once, as joins over one edge table.

Chains come first: a node with one edge in and one out lies inside a chain, and all chains of all graphs are shortened
to one edge with a length by pointer jumping, twice as far each round. What is left branches, and is peeled: a round
releases the nodes all of whose edges in have come, and writes only these and the nodes that still wait. So the number
of rounds follows the branching, not the depth. Rounds are tables in the shared folder: plans stay short however many
there are, and lost executors do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.session import scratch

_NODE = ["graph", "node"]


def _written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    spark, path = df.sparkSession, path or scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _beside(df: DataFrame) -> DataFrame:
    """The other side of a join, to be shuffled: a broadcast would send it through the driver, and anew in every round."""
    return df.hint("merge")


def _counted(df: DataFrame, label: str, what: Column, path: str | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` and count the rows that are ``what`` on the way."""
    seen = Observation()
    out = _written(df.observe(seen, F.count_if(what).alias("n")), label, path)
    return out, seen.get["n"]


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.inline(F.array(F.struct(F.col("src").alias("node")), F.struct(F.col("dst").alias("node"))))).distinct()


@dataclass(frozen=True)
class Shortened:
    """``every`` edge once (graph, src, dst); ``edges`` (graph, src, dst, len) between nodes that branch, begin or end; ``inside`` (graph, node, to, last, len)
    the nodes within chains: the node the chain leads to, its last inner node and the distance; ``rings`` (graph, node,
    least, len) those on a ring without branches, with the ring's least node and its length."""

    every: DataFrame
    edges: DataFrame
    inside: DataFrame
    rings: DataFrame
    rounds: int


def shortened(edges: DataFrame) -> Shortened:
    """Shorten all chains. ``edges`` has ``graph``, ``src`` and ``dst``; repeated edges count once."""
    every = _written(edges.select("graph", "src", "dst").distinct(), "edges")
    outs = every.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("to"))
    ins = every.groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    chained = outs.where("outs = 1").join(_beside(ins.where("ins = 1")), _NODE).select(*_NODE, "to")
    # Those that lead to the end of their chain are done; the others jump to where their target leads.
    start = chained.select(*_NODE, "to", F.col("node").alias("last"), F.col("node").alias("least"), F.lit(1).cast("long").alias("len"))
    inner = _written(start, "chains")
    ahead = F.struct("to", "last", "least", "len").alias("ahead")
    rounds, before = 0, -1
    while True:
        onward = inner.select("graph", F.col("node").alias("to"), ahead)
        met = inner.join(_beside(onward), ["graph", "to"], "left")
        jumped = met.select(
            *_NODE, F.coalesce("ahead.to", "to").alias("to"), F.coalesce("ahead.last", "last").alias("last"),
            F.least("least", "ahead.least").alias("least"), (F.col("len") + F.coalesce("ahead.len", F.lit(0))).alias("len"),
            F.col("ahead").isNotNull().alias("moved"),
        )
        jumped, moving = _counted(jumped, "chains", F.col("moved"))
        # Of chains fewer nodes move each round; those of rings never end, but have seen the whole ring after a while.
        if moving == 0 or moving == before and (1 << rounds) > moving:
            break
        rounds, before, inner = rounds + 1, moving, jumped.drop("moved")
    rings = jumped.where("moved").select(*_NODE, "least")
    inside = jumped.where("not moved").select(*_NODE, "to", "last", "len")
    entering = every.join(_beside(chained.select("graph", F.col("node").alias("src"))), ["graph", "src"], "left_anti")
    first = inside.select("graph", F.col("node").alias("dst"), F.struct("to", "len").alias("chain"))
    short = entering.join(_beside(first), ["graph", "dst"], "left").select(
        "graph", "src", F.coalesce("chain.to", "dst").alias("dst"), (F.coalesce("chain.len", F.lit(0)) + 1).cast("long").alias("len")
    )
    lengths = _written(short.groupBy("graph", "src", "dst").agg(F.max("len").alias("len")), "short")
    return Shortened(every, lengths, inside, rings, rounds)


def _peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(graph, node, level)`` by length of the nodes that an order can place, and the number of rounds."""
    needs = _written(edges.groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("ins")), "needs")
    sources = edges.select("graph", F.col("src").alias("node")).distinct().join(_beside(needs), _NODE, "left_anti")
    none, table, number = F.lit(0).cast("long"), scratch(edges.sparkSession, "levels"), 0
    begun = sources.select(*_NODE, none.alias("came"), none.alias("level"), none.alias("ins"))
    kept, released = _counted(begun, "levels", F.lit(True), f"{table}/round=0")
    while released:
        heads = kept.where("came = ins").select("graph", F.col("node").alias("src"), "level")
        sent = edges.join(_beside(heads), ["graph", "src"]).select(
            "graph", F.col("dst").alias("node"), F.lit(1).cast("long").alias("came"), (F.col("level") + F.col("len")).alias("level")
        )
        waiting = kept.where("came < ins").select(*_NODE, "came", "level")
        came = sent.unionByName(waiting).groupBy(*_NODE).agg(F.sum("came").alias("came"), F.max("level").alias("level"))
        counted = came.join(_beside(needs), _NODE).select(*_NODE, "came", "level", "ins")
        number += 1
        kept, released = _counted(counted, "levels", F.col("came") == F.col("ins"), f"{table}/round={number}")
    levels = edges.sparkSession.read.schema(kept.schema).parquet(table)
    return levels.where("came = ins").select(*_NODE, "level"), number


def _placed(short: Shortened) -> DataFrame:
    """``(graph, node, level)`` of the nodes of edges that an order can place."""
    levels, _ = _peeled(short.edges)
    # A node within a chain lies as far below the chain's entry as its end does, less its distance to the end.
    whole = short.inside.groupBy("graph", "last").agg(F.max_by(F.col("node"), "len").alias("dst"), F.max("len").alias("whole"))
    entered = whole.join(_beside(short.every), ["graph", "dst"]).join(_beside(levels.withColumnRenamed("node", "src")), ["graph", "src"])
    begun = entered.select("graph", "last", (F.col("level") + F.col("whole") + 1).alias("end"))
    within = short.inside.join(_beside(begun), ["graph", "last"]).select(*_NODE, (F.col("end") - F.col("len")).alias("level"))
    return levels.unionByName(within).select(*_NODE, F.col("level").cast("int").alias("level"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph, node, level)``: the longest distance from a source. Nodes on or below a cycle have none: null."""
    short = shortened(edges)
    ends = _ends(short.every)
    alone = nodes.select(*_NODE).distinct().join(_beside(ends), _NODE, "left_anti").withColumn("level", F.lit(0))
    return ends.join(_beside(_placed(short)), _NODE, "left").select(*_NODE, "level").unionByName(alone)


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """``(graph, node)`` of the nodes that no order can place: those on a cycle or below one."""
    short = shortened(edges)
    return _ends(short.every).join(_beside(_placed(short)), _NODE, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of every graph: ``graph``, ``component`` (its least node), ``nodes``, ``is_cycle``.

    Nodes that no cycle reaches, or that reach none, are components of their own. The rest, with chains shortened, is
    split by colouring: the least node that reaches a node is its colour, and of a colour those that reach back to
    that least node are one component; they leave, and the others go on. A component is a cycle if it has several
    nodes or an edge from its node to itself.
    """
    short = shortened(edges)
    core = short.edges
    for names in (("src", "dst"), ("dst", "src")):  # what no cycle reaches, then what reaches none
        turned = core.select("graph", F.col(names[0]).alias("src"), F.col(names[1]).alias("dst"), "len")
        placed = _peeled(turned)[0].select("graph", F.col("node").alias(names[0]))
        core = _written(core.join(_beside(placed), ["graph", names[0]], "left_anti").select("graph", "src", "dst", "len"), "core")
    found, parts = core.select("graph", F.col("src").alias("node"), F.col("src").alias("component")).limit(0), []
    left = core
    while not left.isEmpty():
        colours = _written(_ends(left).withColumn("colour", F.col("node")), "colours")
        while True:
            sent = left.join(_beside(colours.withColumnRenamed("node", "src")), ["graph", "src"]).select("graph", F.col("dst").alias("node"), "colour")
            least = sent.unionByName(colours.select("graph", "node", "colour")).groupBy(*_NODE).agg(F.min("colour").alias("colour"))
            new = _written(least.join(_beside(colours.withColumnRenamed("colour", "old")), _NODE), "colours")
            colours = new.select(*_NODE, "colour")
            if new.where("colour <> old").isEmpty():
                break
        source, target = (colours.select("graph", F.col("node").alias(n), F.col("colour").alias(f"{n}_colour")) for n in ("src", "dst"))
        same = left.join(_beside(source), ["graph", "src"]).join(_beside(target), ["graph", "dst"]).where("src_colour = dst_colour")
        back = _written(same.select("graph", "src", "dst", F.col("src_colour").alias("colour")), "same-colour")
        newest = _written(colours.where("node = colour"), "reached")
        reached = newest
        while not newest.isEmpty():
            onto = back.join(_beside(newest.select("graph", F.col("node").alias("dst"))), ["graph", "dst"], "left_semi")
            newest = _written(onto.select("graph", F.col("src").alias("node"), "colour").distinct().join(_beside(reached.select(*_NODE)), _NODE, "left_anti"), "reached")
            reached = _written(reached.unionByName(newest), "reached")
        parts.append(reached.select("graph", "node", F.col("colour").alias("component")))
        gone = reached.select(*_NODE)
        for name in ("src", "dst"):
            left = left.join(_beside(gone.withColumnRenamed("node", name)), ["graph", name], "left_anti")
        left = _written(left.select("graph", "src", "dst", "len"), "core")
    for part in parts:
        found = found.unionByName(part)
    found = _written(found, "found") if parts else found
    # A chain lies in the component of both its ends, if they have one in common.
    whole = short.inside.groupBy("graph", "last").agg(F.max_by(F.col("node"), "len").alias("dst"), F.first("to").alias("to"))
    entered = whole.join(_beside(short.every), ["graph", "dst"])
    head = found.select("graph", F.col("node").alias("src"), "component")
    tail = found.select("graph", F.col("node").alias("to"), F.col("component").alias("other"))
    chains = entered.join(_beside(head), ["graph", "src"]).join(_beside(tail), ["graph", "to"]).where("component = other").select("graph", "last", "component")
    inner = short.inside.join(_beside(chains), ["graph", "last"]).select(*_NODE, "component")
    cyclic = found.unionByName(inner).unionByName(short.rings.select(*_NODE, F.col("least").alias("component")))
    members = _ends(short.every).join(_beside(cyclic), _NODE, "left").withColumn("component", F.coalesce("component", "node"))
    sizes = members.groupBy("graph", "component").agg(F.count("*").alias("nodes"), F.min("node").alias("least"))
    loops = short.every.where("src = dst").select("graph", F.col("src").alias("component")).withColumn("loop", F.lit(True))
    return sizes.join(_beside(loops), ["graph", "component"], "left").select(
        "graph", F.col("least").alias("component"), "nodes", ((F.col("nodes") > 1) | F.coalesce("loop", F.lit(False))).alias("is_cycle")
    )
