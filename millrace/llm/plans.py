"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bytepairs, collocations, exact, fingerprints, licences, mixing, packing, pages, quality, repeats, sketches, spellings, urls
from millrace.llm.tables import load

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"

#: Weights of the mixture's tree.
WEIGHTS = [{"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {"src0": 2}]
SHARE, EPOCHS, SEED = 0.8, 3, 11


def levels() -> dict[str, Column]:
    """Levels of the mixture's tree. Sources belong to domains by the number in their name."""
    number = F.pmod(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(4)).cast("string")
    return {"domain": F.concat(F.lit("d"), F.coalesce(number, F.lit("x"))), "lang": F.col("lang"), "source": F.col("source")}


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from labels: 0 junk, 1 well written but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.select("doc_id", F.when(F.col("quality").isNotNull(), grade).alias("grade"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, ratings(load(spark, sf_dir, "labels")))
    out = quality.graded(docs, model)
    return out.select(
        "doc_id", F.col("quality.expected").alias("expected_grade"), F.get("quality.tails", F.lit(0)).alias("p_at_least_1"),
        F.get("quality.tails", F.lit(1)).alias("p_at_least_2"), F.col("quality.keep").alias("kept"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(load(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents"), licences.known(spark))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repeated_passages(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a time of fetching, which the table lacks: spread over a month by id."""
    second = F.lit(1704067200).cast("long") + F.pmod(F.col("page_id") * 9973, F.lit(2592000))
    return load(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(second).alias("fetched"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list: each event of a page adds its domain, host or path to the list, or takes it off again."""
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    page = urls.normalised(F.col("url"))
    host = F.regexp_extract(page, "^([^/]*)", 1)
    domain = F.regexp_extract(page, r"([^./]+\.[^./]+)(/|$)", 1)
    name = (
        F.when(F.col("event_type").isin("click", "error"), host)
        .when(F.col("event_type").isin("view", "signup"), domain)
        .otherwise(F.regexp_extract(page, "^([^/]*/[^/]+)", 1))
    )
    pairs = events.join(load(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return pairs.select(name.alias("url"), "ts", (~F.col("event_type").isin("error", "signup")).alias("listed"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(captures(spark, sf_dir), list_entries(spark, sf_dir), "page_id", "url", "fetched")


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(load(spark, sf_dir, "pages"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_duplicates(load(spark, sf_dir, "documents"), digest_all=True)
    return out.withColumnRenamed("digest", "text_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mixed(docs, levels(), WEIGHTS, SHARE, EPOCHS, SEED)
    return out.select("doc_id", "mix.domain", "mix.lang", "mix.source", "mix.tokens", "mix.epoch")


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_TOKENIZER)
    out = bytepairs.decoded(bytepairs.encoded(load(spark, sf_dir, "documents"), path), path)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"), least=10, percent=50, top=2000)


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spellings.vocabulary(load(spark, sf_dir, "documents"), chars=6, least=5, one_in=199)
    return spellings.grouped(words, times=5)


# ---- SQL

_FORM = "trim(regexp_replace({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(replace(lower(coalesce({text}, '')), chr(13), chr(10)), '{licences.COPYRIGHT_LINE}', chr(10), 'g')"
    for pattern, same in licences.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{same}', 'g')"
    return _FORM.format(out)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(
    f"({_quoted(name)}, {_quoted(text)})"
    for name, text in [*licences.LICENCES.items(), *((n, t) for n, ts in licences.NOTICES.items() for t in ts)]
)

OP4_SQL = f"""
WITH known AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(licence) AS licence FROM (VALUES {_KNOWN}) k(licence, text) GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN {_canonical_sql('text')} <> '' THEN sha256({_canonical_sql('text')}) END AS digest, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM l JOIN known ON sha256({_canonical_sql('line')}) = known.digest
      GROUP BY doc_id)
SELECT d.doc_id, d.digest, known.licence, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known ON d.digest = known.digest LEFT JOIN n ON d.doc_id = n.doc_id"""

_NORMAL_URL = r"""regexp_replace(regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '/+$', '')"""
_HOST = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\.', '')"""

OP7_SQL = f"""
WITH b AS (SELECT page_id, url, {_NORMAL_URL} AS bare FROM pages),
p AS (SELECT page_id, url, {_HOST} || regexp_extract(bare, '^[^/]*(/.*)?$', 1) AS page,
             TIMESTAMP '2024-01-01' + to_seconds(CAST((page_id * 9973) % 2592000 AS BIGINT)) AS fetched FROM b),
h AS (SELECT *, regexp_extract(page, '^([^/]*)', 1) AS host, regexp_extract(page, '^([^/]*/[^/]+)', 1) AS first,
             string_split(regexp_extract(page, '^([^/]*)', 1), '.') AS labels FROM p),
k AS (SELECT page_id, fetched, unnest(list_distinct(list_concat([page, first, host],
             list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.'))))) AS key FROM h),
e AS (SELECT CASE WHEN event_type IN ('click', 'error') THEN host WHEN event_type IN ('view', 'signup') THEN regexp_extract(page, '([^./]+\\.[^./]+)(/|$)', 1) ELSE first END AS key,
             ts, bool_or(event_type NOT IN ('error', 'signup')) AS listed
      FROM events JOIN h ON event_id = page_id GROUP BY ALL),
s AS (SELECT k.page_id, k.key, arg_max(e.listed, e.ts) AS listed, max(e.ts) AS last FROM k JOIN e ON k.key = e.key AND e.ts <= k.fetched WHERE k.key <> '' GROUP BY 1, 2),
m AS (SELECT page_id, arg_max(key, (length(key), key)) AS rule, arg_max(last, (length(key), key)) AS since FROM s WHERE listed GROUP BY 1)
SELECT p.page_id, p.url, p.fetched, m.rule IS NOT NULL AS blocked, m.rule, m.since FROM p LEFT JOIN m ON p.page_id = m.page_id"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def _weight_sql(column: str, names: dict) -> str:
    cases = " ".join(f"WHEN {column} = '{name}' THEN {float(w)}" for name, w in names.items())
    return f"CAST(CASE {cases} ELSE 1.0 END AS DOUBLE)"


def _fill_sql(name: str, above: str, parents: list[str], level: str, weights: dict) -> str:
    own = ", ".join([*parents, level])
    group = "PARTITION BY " + ", ".join(f"c.{p}" for p in parents) if parents else ""
    join = " AND ".join(f"c.{p} = u.{p}" for p in parents) or "true"
    return f"""
{name}_c AS (SELECT {own}, sum(cap) AS cap, {_weight_sql(level, weights)} AS weight FROM leaves WHERE size > 0 GROUP BY {own}),
{name}_l AS (SELECT c.*, u.budget, CAST(u.budget - coalesce(sum(c.cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                    / sum(c.weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
             FROM {name}_c c JOIN {above} u ON {join} WINDOW o AS ({group} ORDER BY c.cap / c.weight, c.{level})),
{name} AS (SELECT {own}, CAST(least(cap, floor(weight * max(level) OVER ({group.replace('c.', '')}))) AS BIGINT) AS budget FROM {name}_l)"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, 'd' || coalesce(CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4 AS VARCHAR), 'x') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS size, sum(tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL),
top AS (SELECT least(sum(cap), CAST(floor({SHARE}::DOUBLE * sum(size)) AS BIGINT)) AS budget FROM leaves),
{_fill_sql('a', 'top', [], 'domain', WEIGHTS[0])},
{_fill_sql('b', 'a', ['domain'], 'lang', WEIGHTS[1])},
{_fill_sql('c', 'b', ['domain', 'lang'], 'source', WEIGHTS[2])},
f AS (SELECT leaves.*, c.budget // leaves.size AS whole, c.budget - (c.budget // leaves.size) * leaves.size AS rest FROM c JOIN leaves USING (domain, lang, source)),
o AS (SELECT d.*, f.whole, f.rest, sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{SEED}:' || f.whole || ':' || d.doc_id)) AS upto
      FROM d JOIN f USING (domain, lang, source)),
t AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, CAST(times AS BIGINT))) AS BIGINT) AS epoch FROM t"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM w),
f AS (SELECT lang, 1 AS k, a AS phrase, count(*) AS a, [a] AS w FROM g GROUP BY lang, g.a
      UNION ALL SELECT lang, 2, a || ' ' || b, count(*), [a, b] FROM g WHERE b IS NOT NULL GROUP BY lang, g.a, b
      UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*), [a, b, c] FROM g WHERE c IS NOT NULL GROUP BY lang, g.a, b, c),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
e AS (SELECT * FROM f WHERE a >= 10),
x AS (SELECT e.lang, e.phrase, e.a, cut, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * e.a * e.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
      FROM e JOIN (VALUES (1), (2)) t(cut) ON cut < e.k
      JOIN e l ON l.lang = e.lang AND l.phrase = array_to_string(e.w[1:cut], ' ') JOIN e r ON r.lang = e.lang AND r.phrase = array_to_string(e.w[cut + 1:], ' ')),
s AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM x GROUP BY lang, phrase, a),
o AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM e WHERE k = 3) GROUP BY lang, part),
b AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
      FROM s LEFT JOIN o ON o.lang = s.lang AND o.part = s.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * s.a)
SELECT b.lang, b.rank, b.phrase, b.a, b.l, b.r, n.n, b.score FROM b JOIN n ON b.lang = n.lang WHERE b.rank <= 2000"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_packing, op3_fingerprints, op4_licences, op5_repeats, op6_sketches, op7_urls, op8_pages, op9_exact, op10_mixing,
        op11_bytepairs, op12_collocations, op13_spellings,
    )
}
ORACLES = {"op4_licences": OP4_SQL, "op7_urls": OP7_SQL, "op9_exact": OP9_SQL, "op10_mixing": OP10_SQL, "op12_collocations": OP12_SQL}
