"""Collocations of two and three words, scored from sorted count streams that are read in lockstep.

Tasks sort the grams of a block of text and count equal ones; only these counts are shuffled and summed. Counts of one,
two and three words then lie in one stream in prefix order (a word, then its pairs, then their triples), so that one
reading in order, with no lookup, gives each phrase the counts of its leading words and the largest count of its right
extensions. The same reading of the stream in suffix order gives the counts of trailing words and left extensions.

A triple is counted only where both of its pairs are frequent, which every triple that matters satisfies; frequent
pairs are recognised by a Bloom filter of bounded size, and what it lets through in vain falls to the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrays import LOWER, flat, mixed, word_hashes
from millrace.llm.bloom import filled, holds
from millrace.llm.tables import written

#: Bytes of text whose grams a task counts at once; bounds memory, not what is counted.
BLOCK = 1 << 23
#: Rows of a batch that leaves a task.
ROWS = 1 << 16
#: Parts of a language that are ranked on their own before its best phrases meet.
SALT = 64
LONGEST = 3

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, k int, phrase string, f long"


# ---- counting inside tasks


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words in order, and for each whether the next word lies in the same piece."""
    parted = _BREAK[data]
    inside = ~(parted | _BLANK[data])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(parted)[starts] + np.searchsorted(offsets, starts, side="right")  # both grow, so equal sums are equal places
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    chosen = data[inside]
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(chosen))
    return text.dictionary_encode(), np.append(piece[1:] == piece[:-1], False) if len(starts) else np.zeros(0, bool)


class _Grams:
    """Distinct grams of a block: which each position begins, their counts, and how they are spelt."""

    def __init__(self, words: pa.DictionaryArray, goes_on: np.ndarray):
        self.codes, self.goes_on = words.indices.to_numpy().astype(np.int64), goes_on
        self.spelt = words.dictionary
        data, offsets = flat(self.spelt)
        self.word_keys = word_hashes(data, offsets[:-1], offsets[1:], lower=False)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places where a pair begins, each one's number, and first and second word of every distinct pair."""
        at = np.flatnonzero(self.goes_on)
        values, number = np.unique(self.codes[at] * len(self.spelt) + self.codes[at + 1], return_inverse=True)
        return at, number, values // max(1, len(self.spelt)), values % max(1, len(self.spelt))

    def pair_keys(self, first: np.ndarray, second: np.ndarray, salt: np.uint64) -> np.ndarray:
        return mixed(mixed(self.word_keys[first] * _FACTOR + self.word_keys[second]) + salt)

    def join(self, *parts: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[self.spelt.take(pa.array(p)) for p in parts], pa.scalar(" ", self.spelt.type))


def _salt(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]), lower=False)[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Grams]]:
    """Texts of one language, about ``BLOCK`` bytes at a time; a longer text is a block of its own."""
    waiting, held = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = (held + np.cumsum(sizes)) // BLOCK
        low = 0
        for high in [*(np.flatnonzero(np.diff(run, prepend=0)) + 1), batch.num_rows]:
            if high > low:
                waiting.append(batch.slice(low, high - low))
                held += int(sizes[low:high].sum())
                low = high
            if held >= BLOCK:
                yield from _of_languages(waiting)
                waiting, held = [], 0
    if waiting:
        yield from _of_languages(waiting)


def _of_languages(batches: list[pa.RecordBatch]) -> Iterator[tuple[str, _Grams]]:
    table = pa.Table.from_batches(batches)
    for lang in pc.unique(table.column("lang")).to_pylist():
        data, offsets = flat(table.filter(pc.equal(table.column("lang"), lang)).column("text"))
        yield lang, _Grams(*_words(LOWER[data], offsets))
    pa.default_memory_pool().release_unused()


def _rows(lang: str, k: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(phrases), ROWS):
        part, f = phrases.slice(low, ROWS).cast(pa.string()), counts[low : low + ROWS].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(f)), pa.array(np.full(len(f), k, np.int32)), part, pa.array(f)], ["lang", "k", "phrase", "f"]
        )


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs, and under k = 0 of all words."""
    for lang, grams in _blocks(batches):
        if len(grams.codes) == 0:
            continue
        yield from _rows(lang, 0, pa.array([""]), np.array([len(grams.codes)]))
        yield from _rows(lang, 1, grams.spelt, np.bincount(grams.codes, minlength=len(grams.spelt)))
        _, number, first, second = grams.pairs()
        yield from _rows(lang, 2, grams.join(first, second), np.bincount(number, minlength=len(first)))


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            phrases = batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase")
            data, offsets = flat(phrases)
            spaces = np.flatnonzero(data == 32)
            first = word_hashes(data, offsets[:-1], spaces, lower=False)
            second = word_hashes(data, spaces + 1, offsets[1:], lower=False)
            keys = mixed(mixed(first * _FACTOR + second) + _salt(lang))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), pa.array(keys.view(np.int64))], ["shard", "key"])


def _long(frequent):
    """Counts of triples both of whose pairs the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = frequent.value.get(0)
        for lang, grams in _blocks(batches) if blocks is not None else ():
            at, number, first, second = grams.pairs()
            good = holds(blocks, grams.pair_keys(first, second, _salt(lang)))
            pair_of = np.full(len(grams.codes) + 1, -1, np.int64)
            pair_of[at] = np.where(good[number], number, -1)
            begin = np.flatnonzero((pair_of[:-1] >= 0) & (pair_of[1:] >= 0))
            size = max(1, len(grams.spelt))
            values, counts = np.unique(pair_of[begin] * size + grams.codes[begin + LONGEST - 1], return_counts=True)
            yield from _rows(lang, 3, grams.join(first[values // size], second[values // size], values % size), counts)

    return run


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> DataFrame:
    """Contiguous occurrences of one to three words per language: ``lang``, ``k``, ``phrase``, ``f``, for ``f >= least``.

    A row with ``k`` 0 and an empty phrase has the number of all words. A-Z count as a-z; pieces end at . , ; : ! ?
    and line breaks, words at spaces and tabs. Null texts are empty, a null language is ``und``. Whole texts are read
    twice, once for words and pairs and once for triples. The table is written below the shared folder.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))

    short = written(summed(docs.mapInArrow(_short, _COUNTS)), "phrase-counts")
    keys = short.where("k = 2").mapInArrow(_pair_keys, "shard int, key long")
    frequent = docs.sparkSession.sparkContext.broadcast(filled(keys))
    return short.unionByName(written(summed(docs.mapInArrow(_long(frequent), _COUNTS)), "phrase-counts"))


# ---- streams in order


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read counts in order: ``head1`` and ``head2`` are those of the last word and pair before a longer row, ``longer``
    is the largest count of the triples that follow a pair. A pair is held back until its triples have passed."""
    head1 = head2 = -1
    pair, most = None, 0
    names = ["head1", "head2", "longer"]

    def full(batch: pa.RecordBatch, *columns: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(c, mask=c < 0) for c in columns]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        k, f = batch.column("k").to_numpy(), batch.column("f").to_numpy()

        def last(order: int, before: int) -> np.ndarray:
            at = np.maximum.accumulate(np.where(k == order, np.arange(n), -1))
            return np.where(k > order, np.where(at >= 0, f[at], before), -1)

        one, two = last(1, head1), last(2, head2)
        triples = np.where(k == 3, f, 0)
        begins = np.flatnonzero(k < 3)
        ahead = int(begins[0]) if len(begins) else n
        most = max(most, int(triples[:ahead].max(initial=0)))
        longer = np.zeros(n, np.int64)
        if len(begins):
            longer[begins] = np.maximum.reduceat(triples, begins)
            if pair is not None:
                yield full(pair[0], pair[1], pair[2], np.array([most]))
                pair = None
            end = int(begins[-1])
            if k[end] == 2:
                pair, most = (batch.slice(end, 1), one[end : end + 1], two[end : end + 1]), int(longer[end])
                stays = np.arange(n) != end
                yield full(batch.filter(pa.array(stays)), one[stays], two[stays], longer[stays])
            else:
                most = 0
                yield full(batch, one, two, longer)
        else:
            yield full(batch, one, two, longer)
        head1 = int(f[np.flatnonzero(k == 1)[-1]]) if (k == 1).any() else head1
        head2 = int(f[np.flatnonzero(k == 2)[-1]]) if (k == 2).any() else head2
    if pair is not None:
        yield full(pair[0], pair[1], pair[2], np.array([most]))


def _read_in_order(stream: DataFrame, words: Column, side: str) -> DataFrame:
    """``stream`` with columns ``side`` 1, ``side`` 2 and ``side`` longer from a reading in the order of ``words``.

    Rows are dealt by ranges of their first two words, so that a pair and its triples are never parted but a frequent
    word's pairs are. A task that begins amid such a word's pairs lacks only that one word's count: these few, one or
    none per task, are looked up afterwards.
    """
    ordered = stream.withColumn("order", words)
    dealt = ordered.repartitionByRange("lang", F.slice("order", 1, 2)).sortWithinPartitions("lang", "order")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    read = written(dealt.mapInArrow(_lockstep, f"{fields}, head1 long, head2 long, longer long"), "phrase-stream")
    word = F.get("order", F.lit(0))
    lacking = read.where("k > 1 and head1 is null").select("lang", word.alias("word")).distinct()
    found = stream.where("k = 1").select("lang", F.get("words", F.lit(0)).alias("word"), F.col("f").alias("of_word"))
    found = found.join(F.broadcast(lacking), ["lang", "word"], "left_semi")
    whole = read.withColumn("word", word).join(F.broadcast(found), ["lang", "word"], "left")
    return whole.select(
        *stream.columns, F.when(F.col("k") > 1, F.coalesce("head1", "of_word")).alias(f"{side}1"),
        F.col("head2").alias(f"{side}2"), F.col("longer").alias(f"{side}_longer"),
    )


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in decimals, which hold counts up to 10^15 exactly."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def scored(found: DataFrame, percent: int = 50) -> DataFrame:
    """Phrases of ``counts`` with their worst cut: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``.

    Cutting a phrase in two gives counts l and r of its parts and floor(1000000 a a / (l r)); the cut of the lowest
    score counts, of equal ones the first. A phrase goes if a longer phrase around it has ``percent`` of its count.
    """
    stream = found.where("k > 0").withColumn("words", F.split("phrase", " "))
    both = _read_in_order(_read_in_order(stream, F.col("words"), "left"), F.reverse("words"), "right")
    first = F.struct(_score("f", "left1", "if(k = 2, right1, right2)").alias("score"), F.lit(1).alias("cut"), F.col("left1").alias("l"), F.expr("if(k = 2, right1, right2)").alias("r"))
    later = F.struct(_score("f", "left2", "right1").alias("score"), F.lit(2).alias("cut"), F.col("left2").alias("l"), F.col("right1").alias("r"))
    part = F.col("f") * percent <= F.greatest("left_longer", "right_longer") * 100
    kept = both.where(F.col("k") > 1).where((F.col("k") == 3) | ~part)
    worst = kept.withColumn("worst", F.when(F.col("k") == 3, F.least(first, later)).otherwise(first))
    return worst.select("lang", "phrase", F.col("f").alias("a"), "worst.l", "worst.r", "worst.score")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, percent: int = 50, top: int = 2000
) -> DataFrame:
    """The first ``top`` phrases of each language by score, count (both falling) and bytes of the phrase.

    Columns ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language), ``score``; see
    ``counts`` and ``scored``. Each part of a language sends on its first ``top`` only, so that a language with most of
    the phrases isn't sorted in one task. Empty tables, and languages without a frequent phrase, give no rows.
    """
    found = counts(docs, text_col, lang_col, least)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored(found, percent).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
