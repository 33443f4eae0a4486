"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary is sharded by word length, and each shard has a blocked Bloom filter. Every word generates its
deletions and its replacements by later letters of the alphabet (an insertion is another word's deletion, a
replacement by an earlier letter is found from the other side); an edit's hash follows from the word's by one
addition. Only edits that a filter lets through are spelt out, shuffled and joined with the vocabulary itself, which
removes those that were let through by chance. So each pair of near words is found once, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import mixed
from millrace.llm.bloom import filled, holds
from millrace.llm.tables import written

#: Letters of the words: a to z, and U+00C0 to U+00FF as they stand.
ALPHABET = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: Words of one length whose edits are generated at once.
TOGETHER = 4096
#: Forms are at least five times as frequent, so a chain of 64-bit counts has fewer than 2^5 links.
LEAST_TIMES, ROUNDS = 5, 5

_FACTOR = 0xD1342543DE82EF95
_STEP, _BACK = np.uint64(_FACTOR), np.uint64(pow(_FACTOR, -1, 1 << 64))


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 6, least: int = 5, one_in: int | None = None
) -> DataFrame:
    """Words of at least ``chars`` letters with at least ``least`` occurrences: ``word``, ``n``.

    Words are maximal runs of letters of whole texts, A-Z in lower case. With ``one_in``, a run loses one letter where
    the crc32 of "id:run" is divisible by it (the noise of a test). Null texts have no words. Runs that are too short
    go before anything is hashed, and equal words are added up in the map tasks.
    """
    runs = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= chars)
    word = F.col("run")
    if one_in:
        noise = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (noise % F.char_length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(noise % one_in == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---- inside tasks


def _letters(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the alphabet in order, and a random number for each."""
    codes = np.sort(np.array([ord(c) for c in alphabet], np.uint32))
    return codes, np.random.default_rng(7).integers(1, 1 << 63, len(codes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(batch: pa.RecordBatch, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and letter numbers (a row per word) of words of one length, some at a time."""
    words = batch.column("word").to_pylist()
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        some = max(1, TOGETHER * 16 // max(16, int(size)))
        for low in range(0, len(rows), some):
            part = rows[low : low + some]
            points = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), "<u4").reshape(len(part), size)
            letters = np.minimum(np.searchsorted(codes, points), len(codes) - 1)
            if (codes[letters] != points).any():
                raise ValueError("a word holds a letter that the alphabet lacks")
            yield part, letters


def _sums(letters: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Running sums of letter times power of place; the last is the word's raw hash."""
    sums = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    np.cumsum(random[letters] * _powers(letters.shape[1])[:-1], axis=1, out=sums[:, 1:])
    return sums


def _hashes(alphabet: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, random = _letters(alphabet)
        for batch in batches:
            for part, letters in _by_length(batch, codes):
                keys = mixed(_sums(letters, random)[:, -1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), letters.shape[1], np.int32)), pa.array(keys)], ["shard", "key"])

    return run


def _edits(letters: np.ndarray, random: np.ndarray, filters: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose edit a filter lets through, with the letters of the edit."""
    sums, size = _sums(letters, random), letters.shape[1]
    whole, powers = sums[:, -1], _powers(size)
    same, shorter = filters.get(size), filters.get(size - 1)
    if shorter is not None:
        for at in range(size):
            rows = np.flatnonzero(letters[:, at] != letters[:, at - 1]) if at else np.arange(len(letters))
            keys = mixed(sums[rows, at] + (whole[rows] - sums[rows, at + 1]) * _BACK)
            rows = rows[holds(shorter, keys)]
            yield rows, np.delete(letters[rows], at, axis=1)
    for letter in range(1, len(random)):
        rows, places = np.nonzero(letters < letter)
        keys = mixed(whole[rows] + (random[letter] - random[letters[rows, places]]) * powers[places])
        found = holds(same, keys)
        rows, places = rows[found], places[found]
        edited = letters[rows]
        edited[np.arange(len(rows)), places] = letter
        yield rows, edited


def _probes(alphabet: str, filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, random = _letters(alphabet)
        for batch in batches:
            for part, letters in _by_length(batch, codes):
                for rows, edited in _edits(letters, random, filters.value):
                    if len(rows) == 0:
                        continue
                    text, size = codes[edited].astype("<u4").tobytes().decode("utf-32-le"), edited.shape[1]
                    near = pa.array([text[k : k + size] for k in range(0, len(text), size)], pa.string())
                    own = batch.take(pa.array(part[rows]))
                    yield pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), near], ["word", "n", "near"])

    return run


# ---- tables


def near_pairs(words: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """Each pair of words one edit apart, once: ``word``, ``n``, ``near``, ``near_n``.

    ``words`` has distinct ``word`` of letters of ``alphabet`` and ``n``. It is read several times: give a written table.
    """
    words = words.select("word", "n")
    filters = filled(words.mapInArrow(_hashes(alphabet), "shard int, key long"))
    shared = words.sparkSession.sparkContext.broadcast(filters)
    let_through = words.mapInArrow(_probes(alphabet, shared), "word string, n long, near string")
    return let_through.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def _roots(forms: DataFrame) -> DataFrame:
    """Follow ``form`` from each ``word`` to the end, twice as far each round: ``word``, ``root``."""
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(ROUNDS):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        done = longer.where("next is not null").isEmpty()
        steps = longer.select("word", "root")
        if done:
            break
    return steps


def grouped(words: DataFrame, times: int = 5, alphabet: str = ALPHABET) -> DataFrame:
    """The form and root of every word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` has distinct ``word`` and ``n``. A word's form is its near word of largest ``n`` (ties: the smallest in
    code-point order) if that is at least ``times`` (5 or more) times the word's; else null. ``root`` is the last of the
    chain of forms, the word itself if it has none. ``n_near`` counts near words, 0 if there are none. A word's near
    words are bounded by its edits, so no key is hot, and they are counted in the map tasks first. Null words go; a letter
    outside ``alphabet`` raises; an empty vocabulary gives no rows.
    """
    if times < LEAST_TIMES:
        raise ValueError("forms must be at least five times as frequent")
    words = written(words.select("word", "n").where("word is not null"), "spelling-words")
    both = near_pairs(words, alphabet).select(
        F.inline(
            F.array(
                F.struct("word", "near", F.col("near_n").alias("of")),
                F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("of")),
            )
        )
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("of")).alias("less"), "near")).alias("best"))
    often = -F.col("best.less") >= F.col("n") * times
    formed = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
