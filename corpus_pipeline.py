"""From raw documents to packed training sequences: quality, exact and near duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact, mixing, packing, plans, quality, sketches
from millrace.llm.tables import fresh, load, without, written

#: Share of the tokens left after deduplication that the mixture takes, each document at most once.
SHARE = 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject as junk. It is fitted on the rated documents of the table."""
    rated = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(rated, plans.ratings(load(spark, sf_dir, "labels")))
    (grade,) = fresh(docs, "quality")
    return quality.graded(docs, model, out=grade).where(f"{grade}.keep").select(*docs.columns)


def _kept(docs: DataFrame, decisions: DataFrame, label: str) -> DataFrame:
    """Rows whose id isn't among the dropped ones, without moving texts."""
    return without(docs, written(decisions.where("not kept").select(F.col("doc_id").alias("id")), label))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id."""
    return _kept(docs, exact.exact_duplicates(docs), "exact-dropped")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return _kept(docs, sketches.near_duplicates(docs, width=5, percent=80), "near-dropped")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of domains, languages and sources."""
    (mix_,) = fresh(docs, "mix")
    return mixing.mixed(docs, plans.levels(), plans.WEIGHTS, SHARE, 1, plans.SEED, out=mix_).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path(plans.TOKENIZER))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix),
    ("packing", pack),
]
#: Neither the model, the registers nor byte-pair encoding can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


