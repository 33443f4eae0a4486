"""Mixing sources to target weights: budgets flow down a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import fresh, written

#: Hexadecimal digits of the order key that name a slice of a leaf; only one slice of a leaf is ever sorted.
_DIGITS = 3


def word_count(text: Column) -> Column:
    """Tokens of a text: runs of bytes other than ASCII white space. Null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in a leaf's random order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def weight_of(level: Column, weights: Mapping[str, float]) -> Column:
    """The weight of a name; 1 if it isn't listed."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(level == name, float(weight)).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight``, none above its ``cap``; adds ``share``.

    What a full child can't take goes to its siblings by their weights. With children in the order of cap / weight,
    the common level is the largest of (budget - caps before) / (weights from here on).
    """
    group = Window.partitionBy(*parents)
    order = group.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("budget") - before) / rest)
    return level.withColumn("share", F.least(F.col("cap"), F.floor(F.col("weight") * F.max("level").over(group)))).drop("level")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], total: Column, epochs: int) -> DataFrame:
    """Tokens to take from each leaf: ``leaves`` (the level columns and ``size``) with ``budget``.

    A node can give its leaves' tokens ``epochs`` times. Each level fills its children only up to that, so a
    shortage is made good by siblings first, and by the ancestors' siblings when a whole node is short.
    """
    weighted = leaves.where("size > 0").withColumn("cap", F.col("size") * epochs)
    for level, names in zip(levels, weights):
        weighted = weighted.withColumn(f"w_{level}", weight_of(F.col(level), names))
    upper = weighted.groupBy().agg(F.sum("cap").alias("cap"), F.sum("size").alias("size")).select(F.least("cap", total).alias("budget"))
    upper = upper.withColumn("root", F.lit(0))
    above: list[str] = []
    for depth, level in enumerate(levels):
        own = [*above, level]
        nodes = weighted.groupBy(*own).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight")).where("weight > 0").withColumn("root", F.lit(0))
        placed = nodes.join(upper, ["root", *above])
        filled = fill(placed, ["root", *above], level).select("root", *own, F.col("share").alias("budget"))
        upper, above = filled, own
    return leaves.join(upper.drop("root"), list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0)).cast("long"))


def plan(
    narrow: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], total: Column, epochs: int, seed: int
) -> DataFrame:
    """For each leaf: ``size``, ``budget``, ``full`` epochs and ``cut``, the last order key taken in the epoch after these.

    ``narrow`` holds ``doc_id``, the levels and ``tokens``. Token sums of slices of the order tell in which slice a
    leaf's prefix ends, and only that slice is sorted.
    """
    leaves = written(narrow.groupBy(*levels).agg(F.sum("tokens").alias("size"), F.count("*").alias("rows")), "leaves")
    planned = budgets(leaves, levels, weights, total, epochs)
    full = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0)
    planned = written(
        planned.withColumn("full", full.cast("long")).withColumn("rest", F.col("budget") - F.col("full") * F.col("size")), "budgets"
    )
    keyed = narrow.join(planned.where("rest > 0").select(*levels, "full", "rest"), list(levels))
    keyed = keyed.withColumn("key", order_key(seed, F.col("full"), F.col("doc_id"))).withColumn("slice", F.substring("key", 1, _DIGITS))
    sums = keyed.groupBy(*levels, "rest", "slice").agg(F.sum("tokens").alias("tokens"), F.max("key").alias("last"))
    along = Window.partitionBy(*levels).orderBy("slice")
    sums = sums.withColumn("upto", F.sum("tokens").over(along)).withColumn("before", F.col("upto") - F.col("tokens"))
    sums = written(sums, "slices")
    whole = sums.where("upto <= rest").groupBy(*levels).agg(F.max("last").alias("cut"))
    split = sums.where("before <= rest and upto > rest").select(*levels, "slice", "before")
    inside = keyed.join(split, [*levels, "slice"])
    running = F.sum("tokens").over(Window.partitionBy(*levels, "slice").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", F.col("before") + running).where("upto <= rest").groupBy(*levels).agg(F.max("key").alias("cut"))
    cuts = whole.unionByName(last).groupBy(*levels).agg(F.max("cut").alias("cut"))
    return planned.join(cuts, list(levels), "left")


def mixed(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping[str, float]],
    share: float,
    epochs: int = 1,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "mix",
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with a struct ``out`` (in place of a column of that name) of the levels, ``tokens`` and ``epoch``.

    ``levels`` names the levels of the tree from the top and gives each row's node there; ``weights`` holds each
    level's weights by name (1 if not listed; 0 takes nothing). The budget is ``share`` of all tokens, at most
    ``epochs`` times what there is. A leaf gives whole epochs first and then the longest prefix of a seeded order
    whose tokens fit. Budgets are whole tokens, rounded down. A null level is a name of its own (empty string); null
    texts have no tokens and come along when the order reaches them; rows that share an id stand or fall together.
    """
    ids = {name: F.coalesce(level.cast("string"), F.lit("")).alias(name) for name, level in levels.items()}
    tokens = word_count(F.col(text_col)).alias("tokens")
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), *ids.values(), tokens), "tokens")
    total = narrow.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    planned = plan(narrow, list(levels), weights, F.lit(int(share * total)).cast("long"), epochs, seed)
    own_, leaf_, full_, cut_, epoch_ = fresh(docs, "_mix", "_leaf", "_full", "_cut", "_epoch")
    leaf = written(planned, "plan").select(F.struct(*levels).alias(leaf_), F.col("full").alias(full_), F.col("cut").alias(cut_))
    others = [c for c in docs.columns if c != out]
    rows = docs.withColumn(own_, F.struct(*ids.values(), tokens)).withColumn(leaf_, F.struct(*[F.col(f"{own_}.{n}").alias(n) for n in levels]))
    joined = rows.join(leaf, leaf_)
    again = F.col(cut_).isNotNull() & (order_key(seed, F.col(full_), F.col(id_col)) <= F.col(cut_))
    times = F.col(full_) + again.cast("long")
    taken = joined.where(times > 0).withColumn(epoch_, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return taken.select(*others, F.struct(f"{own_}.*", F.col(epoch_).alias("epoch")).alias(out))
