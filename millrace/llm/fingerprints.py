"""I-Match fingerprints: a text is known by its terms of middling frequency, hashed over several random lexicons."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import bit_set, bit_test, written

#: Terms are hashed to so many slots, so the lexicon is an array of bits of fixed size. All rare terms together add
#: about (terms per text / SLOTS) to the share of texts a slot is found in, far below LEAST, whatever the corpus' size.
SLOTS = 1 << 21
#: The lexicon holds terms found in at least LEAST and at most MOST of all texts.
LEAST, MOST = 0.001, 0.1
#: A rung splits the lexicon at random into 4^rung subsets and hashes the first SUBSETS of them.
RUNGS, SUBSETS, HEX = (2, 3, 4, 5), 16, 4
_NONE = "-" * HEX
SLICE_BYTES, EDGES = 4 << 20, 256


def terms_of(text: Column) -> Column:
    """Slots of the distinct terms of a text: runs without ASCII spaces and marks in lower case, hashed to SLOTS."""
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """``slot`` of each term whose document frequency over all rows lies in the band, and that frequency."""
    n = docs.count()
    terms = docs.select(F.explode(terms_of(F.coalesce(text_col, F.lit("")))).alias("slot"))
    return terms.groupBy("slot").agg(F.count("*").alias("df")).where((F.col("df") >= max(2, least * n)) & (F.col("df") <= most * n))


def with_fingerprint(rows: DataFrame, text_col: str, name: str, words: Column) -> DataFrame:
    """Add the fingerprint of a text; ``words`` is the lexicon as an array of bits."""
    return rows.withColumn("_words", words).withColumn(name, fingerprint(F.col(text_col), F.col("_words"))).drop("_words")


def fingerprint(text: Column, words: Column) -> Column:
    """Number of terms in the band, then for each rung the hashes of its subsets' sorted terms.

    Subsets without a term are dashes; rungs too coarse for so many terms, which no comparison uses, are dots. A text without any term of the band has the hash of all its terms instead.
    """
    def rung(kept: Column, r: int) -> Column:
        placed = F.transform(kept, lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(r)), F.lit(4**r)).alias("subset"), t.alias("t")))

        def digest(own: Column) -> Column:
            short = F.lower(F.lpad(F.hex(F.xxhash64(F.transform(own, lambda x: x["t"])).bitwiseAND(16**HEX - 1)), HEX, "0"))
            return F.when(F.size(own) == 0, _NONE).otherwise(short)

        subsets = F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long"))
        whole = lambda low: F.transform(subsets, lambda k: _bound(F.filter(low, lambda x: x["subset"] == k), digest))
        digests = _bound(F.filter(placed, lambda x: x["subset"] < SUBSETS), lambda low: F.array_join(whole(low), ""))
        return digests if r == RUNGS[-1] else F.when(F.size(kept) <= 4**r, digests).otherwise("." * (SUBSETS * HEX))

    def rungs(kept: Column) -> Column:
        return F.concat(F.size(kept).cast("string"), F.lit(":"), *[rung(kept, r) for r in RUNGS])

    def of(every: Column) -> Column:
        alone = F.concat(F.lit("0:"), F.lower(F.hex(F.xxhash64(F.sort_array(every)))))
        kept = F.sort_array(F.filter(every, lambda t: bit_test(words, t)))
        return _bound(kept, lambda k: F.when(F.size(k) > 0, rungs(k)).otherwise(alone))

    return _bound(terms_of(text), of)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subsets among those with a term, on the rung where a subset has about one term; 0 to 1."""
    n = F.greatest(*[F.substring_index(x, ":", 1).cast("int") for x in (a, b)])
    none = F.least(*[F.substring_index(x, ":", 1).cast("int") for x in (a, b)]) == 0
    step = F.lit(len(RUNGS) - 1)
    for k in reversed(range(len(RUNGS) - 1)):
        step = F.when(n <= 4 ** RUNGS[k], k).otherwise(step)
    own = lambda x: F.substr(F.substring_index(x, ":", -1), step * (SUBSETS * HEX) + 1, F.lit(SUBSETS * HEX))
    numbers = F.sequence(F.lit(0), F.lit(SUBSETS - 1))

    def compared(pair: Column) -> Column:
        part = lambda x, k: F.substr(pair[x], k * HEX + 1, F.lit(HEX))
        same = F.size(F.filter(numbers, lambda k: (part("a", k) == part("b", k)) & (part("a", k) != _NONE)))
        either = F.size(F.filter(numbers, lambda k: (part("a", k) != _NONE) | (part("b", k) != _NONE)))
        return F.when(either == 0, 0.0).otherwise(same / either)

    differ = F.when(none, 0.0).otherwise(_bound(F.struct(own(a).alias("a"), own(b).alias("b")), compared))
    return F.when(a == b, 1.0).otherwise(differ)


def with_next(docs: DataFrame, id_col: str, columns: list[str], text_col: str) -> DataFrame:
    """Each row with ``next_<column>`` of the row of the next smaller id (after the last: of the first).

    Rows are dealt out by slices of the ids with about equal numbers of rows, whatever the ids; the first row of each
    slice also goes to the slice before, so texts are shuffled once.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_col).alias("bytes"))
    seen = ids.agg(F.sum("bytes").alias("bytes"), F.max("id").alias("top"), F.count("id").alias("n")).first()
    wanted = max(1, math.ceil((seen.bytes or 0) / SLICE_BYTES))
    edges = min(wanted, EDGES)
    cuts = sorted({int(q) for q in ids.select("id").stat.approxQuantile("id", [k / edges for k in range(edges)], 0.001)}) if seen.n else [0]
    inner = math.ceil(wanted / len(cuts))
    bounds, top = F.array(*[F.lit(c).cast("long") for c in cuts]), int(seen.top or 0)
    rank = F.greatest(F.size(F.filter(bounds, lambda e: e <= F.col("id"))) - 1, F.lit(0))
    low = F.get(bounds, rank)
    high = F.coalesce(F.get(bounds, rank + 1), F.lit(top + 1))
    within = F.least(F.lit(inner - 1), F.greatest(F.lit(0), F.floor((F.col("id") - low) * inner / F.greatest(high - low, F.lit(1)))))
    slice_of = F.coalesce(rank * inner + within, F.lit(0)).cast("long")

    heads = ids.withColumn("slice", slice_of).groupBy("slice").agg(F.max("id").alias("id"))
    by_slice = Window.orderBy("slice")
    lowest = F.min("slice").over(Window.partitionBy())
    heads = written(heads.withColumn("feeds", F.coalesce(F.lead("slice").over(by_slice), lowest)).select("id", "feeds"), "heads")
    rows = docs.withColumn("id", F.col(id_col).cast("long")).withColumn("slice", slice_of)
    fed = rows.join(heads, "id", "left").withColumn(
        "place", F.explode(F.filter(F.array(F.struct("slice", F.lit(0).alias("extra")), F.struct(F.col("feeds").alias("slice"), F.lit(1).alias("extra"))), lambda p: p["slice"].isNotNull()))
    )
    order = Window.partitionBy("slice").orderBy("extra", F.desc("id"))
    fed = fed.select(*columns, F.col("place.slice").alias("slice"), F.col("place.extra").alias("extra"), "id")
    return fed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("extra = 0").select(*columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """``id``, ``text`` and ``fingerprint`` of each row; null counts as empty. Equal texts have equal fingerprints."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    words = written(bit_set(lexicon(texts, text_col, least, most), SLOTS), "lexicon")
    return with_fingerprint(texts, text_col, "fingerprint", words.scalar())


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """How well fingerprints stand an edit: each text against itself with its last third taken from the next document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(bit_set(lexicon(texts, "text", least, most), SLOTS), "lexicon")
    own = with_fingerprint(texts, "text", "fingerprint", words.scalar())
    both = with_next(own, "doc_id", ["doc_id", "text", "fingerprint"], "text")
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = both.select(
        "doc_id", n.alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substr("text", F.lit(1), n.cast("int") - cut), F.substr("next_text", F.lit(1), cut)).alias("edited"),
    )
    marked = with_fingerprint(edited, "edited", "edited_fingerprint", words.scalar()).withColumn("edited_sha256", F.sha2("edited", 256))
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
