"""The training-data operators against brute force and SQL, and on awkward tables."""

import hashlib
import os
import sys

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute
from oracle_check import compare, duck

import corpus_pipeline
from millrace.llm import exact, fingerprints, licences, mixing, packing, pages, plans, quality, repeats, sketches, urls

SF = "/root/testdata/sf0.001"
TEXT = "".join(f"word{k % 37} is {k * 7919 % 101} of them\n" for k in range(60))
ODD = [
    (1, None, "en", "src1"), (2, "", "en", "src1"), (3, " \n\t ", None, None), (4, TEXT, "en", "src0"), (5, TEXT, "en", "src0"),
    (6, TEXT.replace("word3", "Word3"), "de", "other"), (7, "x" * 5000, "de", "src2"), (8, "one two", "de", "src2"), (9, TEXT * 40, "en", "src0"),
    (10, "two  words", "fr", "src3"), (11, "two words", "fr", "src3"), (12, "日本語　テスト é", "fr", "src3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), None, 1.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string, id double").repartition(3)


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(plans.QUERIES[name](spark, SF).toArrow(), duck(SF).sql(plans.ORACLES[name]).to_arrow_table()) == []


def test_repeats(spark, rows, odd, monkeypatch):
    monkeypatch.setattr(repeats, "FRAGMENT", 1 << 16)
    monkeypatch.setattr(repeats, "BUCKET", 1 << 12)
    for found, texts in ((plans.op5_repeats(spark, SF), rows), (repeats.repeated_passages(odd), [r[:2] for r in ODD])):
        want = brute.repeats(texts)
        if "spans" in found.columns:
            found = found.withColumn("n_spans", F.size("spans"))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()}
        assert got == want


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, odd, width, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for found, texts in ((docs, rows), (odd, [r[:2] for r in ODD])):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketches.near_duplicates(found, width=width, percent=percent).collect()}
        assert got == brute.near(texts, width, percent)


def test_near_duplicates_in_a_chain_are_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[4 * k : 4 * k + 200])) for k in range(40)]
    found = sketches.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), width=3, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.near(chain, 3, 85)


def test_registers_merge_and_estimate():
    import numpy as np

    random = np.random.default_rng(5)
    x = random.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = sketches.registers_of(np.sort(x[:1000])), sketches.registers_of(np.sort(x[500:]))
    assert (np.maximum(a, b) == sketches.registers_of(np.sort(x))).all()
    guess, plausible = sketches.estimate(a[None], b[None], np.array([1000]), np.array([1000]), 0.85)
    assert abs(guess[0] - 1 / 3) < 0.15 and not plausible[0]


def test_packing(spark, rows, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(plans.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    pieces = plans.op2_packing(spark, SF).toArrow().to_pylist()
    assert brute.check_packing(pieces, rows, tokenizer) < 0.03
    brute.check_packing(packing.packed(odd, path).toArrow().to_pylist(), [r[:2] for r in ODD], tokenizer)


def test_texts_that_name_special_tokens():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from millrace.llm.arrays import flat

    path = public_tokenizers.path(plans.TOKENIZER)
    coder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["plain words here", *(f"a {s} b\n c{s}" for s in coder.special), None, "日本 é " + "".join(coder.special), "more  words"]
    ids, reach, _, _ = coder.encode(*flat(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[reach[k] : reach[k + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_checksum_of_a_part():
    import zlib

    data = bytes(range(200))
    for cut in (0, 1, 64, 199):
        assert packing.part_crc(zlib.crc32(data[:cut]), zlib.crc32(data), len(data) - cut) == zlib.crc32(data[cut:])


def test_fingerprints(spark, rows, odd):
    found = plans.op3_fingerprints(spark, SF).collect()
    edited = brute.edited(rows)
    assert {r.doc_id: r.edited_sha256 for r in found} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in edited.items()}
    texts = dict(rows)
    by_text = {}
    for r in found:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited for r in found) > 5 * sum(r.near_next for r in found)
    strange = {r.doc_id: r for r in fingerprints.edited_likeness(odd).collect()}
    want = brute.edited([r[:2] for r in ODD])
    assert all(hashlib.sha256(want[k].encode()).hexdigest() == r.edited_sha256 for k, r in strange.items()) and len(strange) == len(ODD)
    assert strange[4].fingerprint == strange[5].fingerprint and strange[1].fingerprint == strange[2].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in strange.values())


def test_pages(spark):
    source = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in plans.op8_pages(spark, SF).collect():
        assert r.text == brute.article(source[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>a &amp; b", "a & b"), ("plain   text", "plain text"), ("<script>x</script>", ""), ("<a title='x>y", "y"),
        ("<body><nav>n</nav><article><h1>T</h1><p>one<p>two <b>bold</article><footer>f</footer>", "T\none\ntwo bold"),
        ("<div class=content><p>Long enough text of an article, really.</p><p>And more of it.</p></div><div id=comments><p>No, I disagree!</p></div>",
         "Long enough text of an article, really.\nAnd more of it."),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page) == text


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    graded = plans.ratings(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = quality.fit(docs, graded.where("doc_id % 2 = 0"))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    held = quality.graded(docs.join(graded.where("doc_id % 2 = 1"), "doc_id"), model)
    right, n = held.agg(F.count_if(F.col("quality.keep") == (F.col("grade") >= 1)), F.count("*")).first()
    assert right / n > 0.95


def test_quality_of_odd_rows(spark, odd):
    model = quality.fit(odd, spark.createDataFrame([(4, 2), (7, 0), (7, 1), (8, None)], "doc_id long, grade int"))
    found = {r.doc_id: r.quality for r in quality.graded(odd, model).collect()}
    assert len(found) == len(ODD) and not found[1].keep and found[2].expected == 0 and found[4].keep
    none = quality.fit(odd, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.graded(odd, none).count() == len(ODD)


def test_exact_duplicates(odd):
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(odd).collect()}
    assert found[5] == (4, 2, False) and found[4] == (4, 2, True) and found[11] == (10, 2, False) and found[2] == (1, 2, False)
    assert found[3] == (3, 1, True) and len(found) == len(ODD)


def test_mixing_redistributes_among_siblings_first(spark):
    sizes = {("a", "x", "s1"): 10, ("a", "x", "s2"): 100, ("a", "y", "s3"): 100, ("b", "x", "s4"): 1000}
    leaves = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "domain string, lang string, source string, size long")
    found = mixing.budgets(leaves, ["domain", "lang", "source"], [{}, {}, {}], F.lit(200).cast("long"), 1)
    assert {r.source: r.budget for r in found.collect()} == {"s1": 10, "s2": 40, "s3": 50, "s4": 100}


def test_mixing_of_odd_rows(odd):
    found = mixing.mixed(odd, plans.levels(), plans.WEIGHTS, 0.5, 2, 3)
    assert set(odd.columns) <= set(found.columns)
    tokens = found.agg(F.sum("mix.tokens")).first()[0] or 0
    assert tokens <= 0.5 * sum(len((r[1] or "").split()) for r in ODD)


def test_licences(spark):
    mit = licences.LICENCES["MIT"].replace("MIT License", "mit LICENCE:").replace("<year> <copyright holders>", "1999 Jo")
    docs = spark.createDataFrame([(1, mit, 0), (2, "x\n// Released under the MIT License!\ny", 0), (3, None, 0), (4, mit + " more", 0)], "doc_id long, text string, licence int")
    found = {r.doc_id: (r.licence, r.notices) for r in licences.scan(docs, licences.known(spark)).collect()}
    assert found == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}


def test_every_known_text_and_line_is_found(spark):
    """Whole texts with another owner, case and wrapping; lines of a list given as a table, whatever words they hold."""
    reflow = lambda text: text.upper().replace("\n", "\r\n").replace(". ", ".\n    ").replace("<YEAR>", "2001")
    docs = [(n, reflow(text)) for n, text in enumerate(licences.LICENCES.values())]
    docs += [(n + 100, "Preface\n" + text) for n, text in docs] + [(300, "a\n * This work is in the public domain.\nb"), (301, "\n\n"), (302, "public domain")]
    table = licences.known(spark).unionByName(spark.createDataFrame([("PD", "This work is in the public domain."), ("none", "--")], "licence string, text string"))
    rows = licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    found = {r.doc_id: (r.licence, r.notices) for r in rows}
    assert len(rows) == len(docs)
    assert [found[n][0] for n in range(len(licences.LICENCES))] == list(licences.LICENCES)
    assert all(found[n + 100][0] is None for n in range(len(licences.LICENCES)))
    assert (found[300], found[301], found[302]) == ((None, "PD"), (None, ""), (None, ""))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(empty, table).count() == 0


def test_urls(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    captures = spark.createDataFrame(
        [(1, "http://www.A.example.com/x?q", at(2)), (2, "https://a.example.com/x/", at(5)), (3, "http://b.example.com/", at(9)), (4, None, at(9)), (5, "http://a.example.com/x", None)],
        "id long, url string, fetched string",
    ).withColumn("fetched", F.col("fetched").cast("timestamp"))
    entries = spark.createDataFrame(
        [("a.example.com/x", at(1), True), ("a.example.com/x", at(4), False), ("example.com", at(8), True), (None, at(1), True), ("b.example.com", None, True)],
        "url string, ts string, listed boolean",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    found = {r.id: (r.blocked, r.rule) for r in urls.filtered(captures, entries, "id", "url", "fetched").collect()}
    assert found == {1: (True, "a.example.com/x"), 2: (False, None), 3: (True, "example.com"), 4: (False, None), 5: (False, None)}


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert exact.exact_duplicates(none).count() == sketches.near_duplicates(none).count() == repeats.repeated_passages(none).count() == 0
    assert fingerprints.edited_likeness(none).count() == mixing.mixed(none, plans.levels(), plans.WEIGHTS, 0.5).count() == 0
    import public_tokenizers

    assert packing.packed(none, public_tokenizers.path(plans.TOKENIZER)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [set(r.doc_id for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    assert len(ids[-1]) < len(ids[0])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == ids[-1]
