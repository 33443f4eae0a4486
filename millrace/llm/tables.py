"""Reading, writing and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lost executors recompute nothing of what came before."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bit_set(slots: DataFrame, bits: int) -> DataFrame:
    """One row with ``words``, an array of bits / 64 numbers; a bit is set if the column ``slot`` of ``slots`` names it."""
    word = F.floor(F.col("slot") / 64).cast("int")
    found = slots.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    none = slots.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    every = found.unionByName(none).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"))


def bit_test(words: Column, slot: Column) -> Column:
    return F.call_function("bit_get", F.get(words, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores until no column of ``df`` (whatever its case) has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", bits: int = 1 << 24) -> DataFrame:
    """Rows of ``docs`` whose id isn't among the column ``id`` of ``dropped``; texts stay where they are read.

    A filter of fixed size (2 MB) lets rows pass whose id it doesn't hold. Ids that it holds by chance get a second
    filter: rows in the first alone are dropped. Only rows in both, a small share of a small share, are moved to be
    joined exactly. Filters that fill up, beyond some millions of dropped ids, move more rows; the result is the same.
    """
    held_, kept_ = fresh(docs, "held", "kept")

    def slot(column: Column | str, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(bits))

    first = bit_set(dropped.select(slot("id", 1).alias("slot")), bits).scalar()
    ids = docs.select(F.col(id_col).alias("id"))
    by_chance = ids.where(bit_test(first, slot("id", 1))).join(dropped, "id", "left_anti")
    second = bit_set(by_chance.select(slot("id", 2).alias("slot")), bits).scalar()
    marked = docs.withColumn(held_, bit_test(first, slot(id_col, 1))).withColumn(kept_, F.col(held_) & bit_test(second, slot(id_col, 2)))
    passed = marked.where(~F.coalesce(F.col(held_), F.lit(False)))
    doubtful = marked.where(kept_)
    exact = doubtful.join(dropped.select(F.col("id").alias(held_ + "_id")), doubtful[id_col] == F.col(held_ + "_id"), "left_anti")
    return passed.select(*docs.columns).unionByName(exact.select(*docs.columns))
