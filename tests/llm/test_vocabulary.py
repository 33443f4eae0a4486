"""Byte-pair encoding, collocations and spelling variants against brute force, and on awkward tables."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_check import compare, duck
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from millrace.llm import arrays, bloom, bytepairs, collocations, mixing, packing, plans, quality, sketches, spellings, tables

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path(plans.WORD_TOKENIZER)
ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "und"), (4, "It's <|endoftext|>NOT<|startoftext|> 12 ΣΑΣ İstanbul", "en"), (5, "aaaa aaaaa aaaaaaaaa" * 50, "en"),
    (6, "日本語　テスト é é", "ja"), (7, "x" * 30000, "de"), (8, "word " * 40000, "de"), (8, "word " * 40000, "de"), (9, "naïve naïvé naive×", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "w", 2.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, word string, ids double").repartition(3)


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()


# ---- byte pairs


def test_ids_and_texts_are_the_tokenizers(spark, texts, odd):
    whole = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table, rows in ((docs, texts), (odd, ODD)):
        found = bytepairs.decoded(bytepairs.encoded(table, WORDS), WORDS).collect()
        want = [(i, whole.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
        want = sorted((i, ids, whole.decode(ids, skip_special_tokens=False)) for i, ids in want)
        assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in found) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in found)


def test_query_of_byte_pairs(spark, texts):
    whole = Tokenizer.from_file(WORDS)
    for r in plans.op11_bytepairs(spark, SF).collect():
        ids = whole.encode(dict((t[0], t[1]) for t in texts)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_code_point_is_split_alike():
    whole, codec = Tokenizer.from_file(WORDS), bytepairs.Codec(WORDS)
    some = [f"a{chr(c)}b 1{chr(c)}2" for c in [*range(0x3100), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D500)]]
    ids, counts = codec.encode(pa.array(some))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for k, e in enumerate(whole.encode_batch(some, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids


def test_ranks_apply_in_order_and_runs_from_the_left():
    vocab = {s: k for k, s in enumerate(["a", "b", "c", "aa", "ab", "aab", "bc"])}
    merges = bytepairs.Merges([("a", "a"), ("b", "c"), ("a", "b"), ("aa", "b")], vocab)

    def one(word):
        index = bytepairs.PairIndex(np.array([vocab[c] for c in word]), np.array([len(word)]), merges)
        index.apply()
        return index.symbols[index.alive].tolist()

    assert one("aaa") == [vocab["aa"], vocab["a"]] and one("aaaaa") == [vocab["aa"], vocab["aa"], vocab["a"]]
    assert one("aaab") == [vocab["aa"], vocab["ab"]] and one("aab") == [vocab["aab"]] and one("abc") == [vocab["a"], vocab["bc"]]


def test_a_merge_made_of_a_later_one_is_refused():
    with pytest.raises(ValueError):
        bytepairs.Merges([("ab", "c"), ("a", "b")], {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4})


# ---- collocations


def phrases(rows, least=10, percent=50, top=2000):
    import re

    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lowered(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in often.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        rows_ = []
        for p, a in often.items():
            if 100 * longer[p] >= percent * a and longer[p]:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def test_collocations(spark, texts, odd, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = spark.createDataFrame([(k, "the cat sat. the cat ran, a the dog the " * (k % 7), "en") for k in range(60)], "doc_id long, text string, lang string")
    hot_rows = [(r.doc_id, r.text, r.lang) for r in hot.collect()]
    for table, rows, least in ((docs, texts, 10), (docs, texts, 3), (odd, ODD, 1), (hot, hot_rows, 2)):
        found = collocations.collocations(table, least=least, top=50)
        assert {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == phrases(rows, least, top=50)


def test_collocations_when_everything_is_split(spark, texts, monkeypatch):
    """Small blocks, a filter that lets much through, and ranges that part a frequent word's pairs."""
    monkeypatch.setattr(bloom, "MOST", 4)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=4, top=500)
        assert {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == phrases(texts, 4, top=500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**14 + 7, 3 * 10**14 + 1, 2 * 10**14 + 9)], "a long, l long, r long")
    a, left, right, score = big.select("a", "l", "r", collocations._score("a", "l", "r")).first()
    assert score == 1000000 * a * a // (left * right)


def test_streams_are_read_across_batches(spark):
    rows = [(1, 50), (2, 20), (3, 9), (3, 12), (2, 30), (3, 7), (1, 5), (2, 4)]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows[i : i + size]], pa.int32()), "f": [r[1] for r in rows[i : i + size]]}) for i in range(0, 8, size)]
        out = pa.Table.from_batches(collocations._lockstep(iter(batches))).to_pylist()
        pairs = {(r["f"], r["head1"], r["longer"]) for r in out if r["k"] == 2}
        assert pairs == {(20, 50, 12), (30, 50, 7), (4, 5, 0)}
        assert {(r["f"], r["head1"], r["head2"]) for r in out if r["k"] == 3} == {(9, 50, 20), (12, 50, 20), (7, 50, 30)}


# ---- spellings


def variants(words: dict[str, int]):
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            for x in [w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in spellings.ALPHABET)]:
                if x != w and x in words:
                    near[w].add(x)
                    near[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("most", [1 << 22, 8])
def test_spellings(spark, texts, most, monkeypatch):
    import re
    import zlib

    monkeypatch.setattr(bloom, "MOST", most)
    counts = Counter()
    for i, text, _ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lowered(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    want = variants({w: n for w, n in counts.items() if n >= 5})
    assert {tuple(r) for r in plans.op13_spellings(spark, SF).select(*COLUMNS).collect()} == want


def test_chains_of_forms_and_long_words(spark):
    words = {"z" * 6 + "b" * k: 5**k for k in range(1, 9)} | {"é" * 3000: 7, "é" * 2999: 40, "è" + "é" * 2999: 40, "àbcdef": 5, "ÿbcdef": 30, "bcdef": 30}
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, form int")
    assert {tuple(r) for r in spellings.grouped(table).select(*COLUMNS).collect()} == variants(words)


def test_words_of_awkward_texts(spark, odd):
    assert {(r.word, r.n) for r in spellings.vocabulary(odd, chars=4, least=1).collect()} >= {("word", 80000), ("naïve", 1), ("naive×", 1), ("x" * 30000, 1)}
    with pytest.raises(ValueError):
        spellings.grouped(odd, times=2)


# ---- shared


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert bytepairs.decoded(bytepairs.encoded(none, WORDS), WORDS).count() == 0
    assert collocations.collocations(none).count() == spellings.grouped(spellings.vocabulary(none)).count() == 0


def thue_morse(n: int) -> str:
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_a_pattern_differ(spark, n):
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    data, offsets = arrays.flat(pa.array([one, two]))
    assert len(set(arrays.word_hashes(data, offsets[:-1], offsets[1:]).tolist())) == 2
    docs = spark.createDataFrame([(1, f"{one} x y z"), (2, f"{two} x y z"), (3, f"{one} x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in sketches.near_duplicates(docs, width=5, percent=80).collect()} == {1: 1, 2: 2, 3: 1}
    path = public_tokenizers.path(plans.TOKENIZER)
    coder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    texts = [f"x {one} y", f"x {two} y"]
    ids, reach, _, _ = coder.encode(*arrays.flat(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[reach[k] : reach[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_units_that_share_the_first_hash(monkeypatch):
    """With a first hash of two values the second one must tell units apart."""
    whole_hash = arrays.word_hashes
    monkeypatch.setattr(packing, "word_hashes", lambda *a, seed=0, **k: whole_hash(*a, seed=seed, **k) if seed else whole_hash(*a, **k) & np.uint64(1))
    path = public_tokenizers.path(plans.TOKENIZER)
    coder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    for text in ("one two three four five six", "six five four eight nine one two"):
        ids, reach, _, _ = coder.encode(*arrays.flat(pa.array([text])))
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_rows_without_dropped_ids(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("held"), F.lit(1).alias("kept"), F.lit(2).alias("id"))
    dropped = spark.range(0, 5000, 7).select("id")
    for bits in (64, 1 << 12, 1 << 24):
        left = tables.without(docs, dropped, bits=bits)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [k for k in range(5000) if k % 7]


def test_stages_keep_the_values_of_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("quality", "quality_", "mix", "_leaf", "_full", "_cut", "_mix", "_epoch", "held", "kept", "id")})
    before = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(before[r.doc_id] == r for r in rows)


def test_tails_against_finite_differences(spark):
    """The fitted model's likelihood can't be raised by moving a threshold or the used weights together."""
    docs = spark.createDataFrame([(k, ("good words here " if k % 3 else "bad stuff ") * (1 + k % 4) + f"w{k % 5}") for k in range(60)], "doc_id long, text string")
    grades = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1 + k % 2) for k in range(60)], "doc_id long, grade int")
    model = quality.fit(docs, grades)
    rows = {r.doc_id: r.quality for r in quality.graded(docs, model).collect()}
    for k, r in rows.items():
        score = model.scores(*arrays.flat(pa.array([("good words here " if k % 3 else "bad stuff ") * (1 + k % 4) + f"w{k % 5}"])))[0][0]
        tails = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert np.allclose(r.tails, tails) and abs(r.expected - sum(tails)) < 1e-9 and r.keep == (tails[0] >= 0.5)

    def loss(shift: float) -> float:
        total = 0.0
        for k in range(60):
            score = model.scores(*arrays.flat(pa.array([("good words here " if k % 3 else "bad stuff ") * (1 + k % 4) + f"w{k % 5}"])))[0][0]
            tails = [1.0, *(1 / (1 + np.exp(-(score - t - shift))) for t in model.thresholds), 0.0]
            grade = 0 if k % 3 == 0 else 1 + k % 2
            total -= np.log(tails[grade] - tails[grade + 1])
        return total

    assert loss(0.0) <= min(loss(0.5), loss(-0.5)) + 1e-6
