"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import bit_set, bit_test, written

#: Bits of the filter that tells which (length, prefix) groups have several rows; fixed, so its size never grows.
FILTER_BITS = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False
) -> DataFrame:
    """Which row stays for each normalised text: id, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    The first pass leaves only a length and the hash of the first ``prefix`` characters of each text and counts
    groups, by length and then by both. The second pass hashes whole texts, but only of rows whose group survived
    (``digest_all`` hashes the others too, without grouping them); rows are told apart by a filter of fixed size, so
    no text is ever shuffled. A slot shared by chance only means that a text is hashed in vain. The smallest id of
    equal texts stays; null counts as empty; ids are unique (of rows that repeat an id each gets a row). ``digest``
    is the SHA-256 of the normalised text, null where it wasn't needed.
    """
    text = normalised(F.col(text_col))
    looked_at = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", "t", F.char_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("head")
    )
    slot = F.pmod(F.xxhash64("len", "head"), F.lit(FILTER_BITS))
    pairs = looked_at.groupBy("len", "head").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("of_len")).where("of_len > 1")
    survivors = pairs.where("n > 1").join(lengths, "len", "left_semi").select(slot.alias("slot"))
    words = bit_set(survivors, FILTER_BITS).scalar()
    tested = looked_at.withColumn("again", bit_test(words, slot))
    digest = F.sha2("t", 256) if digest_all else F.when(F.col("again"), F.sha2("t", 256))
    hashed = written(tested.select("id", "again", digest.alias("digest")), "exact")
    groups = hashed.where("again").groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    several = hashed.where("again").join(groups, "digest").select("id", "keep_id", "group_size", "digest")
    single = hashed.where("not again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return several.unionByName(single).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "digest"
    )
