"""One query per family of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, encode, text, values
from millrace.plans.registry import query

SP = text.SPACE


@query(
    "fn_encode",
    """SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, lower(hex(encode(lang))) AS hexed,
              decode(unhex(lower(hex(encode(lang))))) AS unhexed, base64(encode(source)) AS b64,
              decode(from_base64(base64(encode(source)))) AS unb64,
              translate(base64(encode(text)), '+/', '-_') AS url_b64,
              decode(from_base64(translate(translate(base64(encode(text)), '+/', '-_'), '-_', '+/'))) = text AS url_round,
              CASE WHEN lang < source THEN -1 WHEN lang > source THEN 1 ELSE 0 END AS compared
       FROM documents""",
)
def fn_encode(t):
    c = F.col
    return t.documents.select(
        "doc_id",
        encode.checksum(c("text"), "md5").alias("md5"),
        encode.checksum(c("text"), "sha256").alias("sha256"),
        encode.to_hex(c("lang")).alias("hexed"),
        encode.from_hex(encode.to_hex(c("lang"))).cast("string").alias("unhexed"),
        encode.to_base64(c("source")).alias("b64"),
        encode.from_base64(encode.to_base64(c("source"))).cast("string").alias("unb64"),
        encode.to_url_base64(c("text")).alias("url_b64"),
        (encode.from_url_base64(encode.to_url_base64(c("text"))).cast("string") == c("text")).alias("url_round"),
        encode.compare_bytes(c("lang"), c("source")).alias("compared"),
    )


@query(
    "fn_date_format",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, strftime(ts, '%Y-%m-%d') AS day,
              strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, strftime(ts, '%d/%m/%Y') AS custom,
              date_trunc('second', ts) AS parsed_rfc, date_trunc('second', ts) AS parsed_datetime,
              CAST(NULL AS TIMESTAMP) AS parsed_bad,
              date_trunc('second', ts) - INTERVAL 9 HOUR AS parsed_tokyo
       FROM events""",
)
def fn_date_format(t):
    ts = F.col("ts")
    stamp = dates.format_datetime(ts)
    return t.events.select(
        "event_id",
        dates.format_time(ts).alias("rfc3339"),
        dates.format_date(ts).alias("day"),
        stamp.alias("datetime"),
        dates.format_time(ts, "dd/MM/yyyy").alias("custom"),
        dates.parse_time(dates.format_time(ts)).alias("parsed_rfc"),
        dates.parse_time(stamp, "yyyy-MM-dd HH:mm:ss").alias("parsed_datetime"),
        dates.parse_time(F.col("event_type"), "yyyy-MM-dd").alias("parsed_bad"),
        dates.parse_in_zone(stamp, "yyyy-MM-dd HH:mm:ss", "Asia/Tokyo").alias("parsed_tokyo"),
    )


@query(
    "fn_date_math",
    """SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) / 1000000 AS age_seconds,
              (epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) // 1000 AS age_millis,
              (epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) // 86400000000 AS age_days,
              ts + INTERVAL 14 MONTH + INTERVAL 3 DAY AS plus_calendar,
              ts + INTERVAL 90 SECOND AS plus_seconds, ts - INTERVAL 90 SECOND AS minus_seconds
       FROM events""",
)
def fn_date_math(t):
    ts, as_of = F.col("ts"), F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    return t.events.select(
        "event_id",
        dates.seconds_between(ts, as_of).alias("age_seconds"),
        dates.milliseconds_between(ts, as_of).alias("age_millis"),
        dates.days_between(ts, as_of).alias("age_days"),
        dates.add_calendar(ts, years=1, months=2, days=3).alias("plus_calendar"),
        dates.add_seconds(ts, 90).alias("plus_seconds"),
        dates.add_seconds(ts, -90).alias("minus_seconds"),
    )


@query(
    "fn_date_trunc",
    "SELECT event_id, "
    + ", ".join(
        f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS begin_{u}, "
        f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) + INTERVAL 1 {u} - INTERVAL 1 MICROSECOND AS end_{u}"
        for u in ("day", "week", "month", "year")
    )
    + " FROM events",
)
def fn_date_trunc(t):
    units = ("day", "week", "month", "year")
    pairs = [(dates.begin_of(u, F.col("ts")), dates.end_of(u, F.col("ts")), u) for u in units]
    named = [c for b, e, u in pairs for c in (b.alias(f"begin_{u}"), e.alias(f"end_{u}"))]
    return t.events.select("event_id", *named)


@query(
    "fn_date_pred",
    """SELECT event_id, CAST(ts AS DATE) = DATE '2024-01-15' AS is_today, CAST(ts AS DATE) = DATE '2024-01-14' AS is_yesterday,
              CAST(ts AS DATE) = DATE '2024-01-16' AS is_tomorrow,
              CAST(ts AS DATE) = CAST(ts + INTERVAL 6 HOUR AS DATE) AS same_day
       FROM events""",
)
def fn_date_pred(t):
    ts, as_of = F.col("ts"), F.lit("2024-01-15 10:00:00").cast("timestamp_ntz")
    return t.events.select(
        "event_id",
        dates.day_offset_is(ts, as_of, 0).alias("is_today"),
        dates.day_offset_is(ts, as_of, -1).alias("is_yesterday"),
        dates.day_offset_is(ts, as_of, 1).alias("is_tomorrow"),
        dates.same_day(ts, ts + F.expr("INTERVAL 6 HOUR")).alias("same_day"),
    )


@query(
    "fn_string",
    f"""SELECT doc_id, concat_ws('-', lang, source) AS joined, len(string_split(text, '. ')) AS pieces,
               regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') AS trimmed, ltrim(source, 'sr') AS cut_left,
               rtrim(source, '0123456789') AS cut_right, lower(text) AS lowered, upper(source) AS uppered,
               starts_with(text, 'The') AS has_prefix, ends_with(text, '.') AS has_suffix,
               replace(text, 'an', 'AN') AS replaced, (length(text) - length(replace(text, 'an', ''))) // 2 AS counted,
               regexp_matches(text, '[@#%]') AS any_char, len(regexp_extract_all(text, '[.?]')) > 0 AS any_func
        FROM documents""",
)
def fn_string(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        F.concat_ws("-", "lang", "source").alias("joined"),
        F.size(text.split_on(c, ". ")).cast("bigint").alias("pieces"),
        text.trim_space(c).alias("trimmed"),
        text.trim_left(F.col("source"), "sr").alias("cut_left"),
        text.trim_right(F.col("source"), "0123456789").alias("cut_right"),
        F.lower(c).alias("lowered"),
        F.upper("source").alias("uppered"),
        F.startswith(c, F.lit("The")).alias("has_prefix"),
        F.endswith(c, F.lit(".")).alias("has_suffix"),
        F.replace(c, F.lit("an"), F.lit("AN")).alias("replaced"),
        text.count_of(c, "an").alias("counted"),
        text.contains_any(c, "@#%").alias("any_char"),
        text.contains_any(c, ".?").alias("any_func"),
    )


@query(
    "fn_length",
    f"""SELECT r.doc_id, strlen(text) AS n_bytes, length(text) AS n_chars, regexp_matches(text, '^{SP}*$') AS blank,
               NOT regexp_matches(text, '^{SP}*$') AS not_blank,
               coalesce(nullif(CASE WHEN r.doc_id % 2 = 0 THEN '' ELSE lang END, ''), 'none') AS lang_or_default,
               coalesce(nullif(quality, 0), 7) AS quality_or_default
        FROM records r""",
)
def fn_length(t):
    c = F.col("text")
    return t.records.select(
        "doc_id",
        F.octet_length(c).cast("bigint").alias("n_bytes"),
        F.char_length(c).cast("bigint").alias("n_chars"),
        text.is_blank(c).alias("blank"),
        (~text.is_blank(c)).alias("not_blank"),
        text.or_default(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), "none").alias("lang_or_default"),
        text.or_default(F.col("quality"), 7).alias("quality_or_default"),
    )


@query(
    "fn_pad",
    """SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substring(text, 1, 40) || '...' END AS cut,
              CASE WHEN length(source) >= 5 THEN source ELSE lpad(source, 5, '*') END AS padded_left,
              CASE WHEN length(source) >= 5 THEN source ELSE rpad(source, 5, '*') END AS padded_right
       FROM documents""",
)
def fn_pad(t):
    return t.documents.select(
        "doc_id",
        text.truncate(F.col("text"), 40).alias("cut"),
        text.pad_left(F.col("source"), 5, "*").alias("padded_left"),
        text.pad_right(F.col("source"), 5, "*").alias("padded_right"),
    )


_TITLE = "upper(substring(w, 1, 1)) || lower(substring(w, 2))"
_SNAKE = r"lower(substring({c}, 1, 1) || regexp_replace(substring({c}, 2), '(\p{{Lu}})', '_\1', 'g'))"


@query(
    "fn_case",
    f"""SELECT p_partkey, reverse(p_name) AS reversed,
               array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''),
                   lambda w: {_TITLE}), '') AS pascal,
               array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''),
                   lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE {_TITLE} END), '') AS camel,
               {_SNAKE.format(c="p_brand || 'PartName'")} AS snake,
               replace({_SNAKE.format(c="p_brand || 'PartName'")}, '_', '-') AS kebab
        FROM part""",
)
def fn_case(t):
    styled = F.concat("p_brand", F.lit("PartName"))
    return t.part.select(
        "p_partkey",
        F.reverse("p_name").alias("reversed"),
        text.pascal_case(F.col("p_name")).alias("pascal"),
        text.camel_case(F.col("p_name")).alias("camel"),
        text.snake_case(styled).alias("snake"),
        text.kebab_case(styled).alias("kebab"),
    )


_UUID = "concat_ws('-', substring(md5(html), 1, 8), substring(md5(html), 9, 4), substring(md5(html), 13, 4), " \
        "substring(md5(html), 17, 4), substring(md5(html), 21, 12))"


@query(
    "fn_checks",
    f"""WITH x AS (SELECT page_id, url, {_UUID} AS uid,
                          CASE WHEN page_id % 2 = 0 THEN 'user' || page_id || '@example.org' ELSE url END AS mail,
                          regexp_extract(url, '/([a-z0-9]+)', 1) AS word FROM pages)
        SELECT page_id, regexp_matches(mail, '{text.EMAIL}') AS email, regexp_matches(url, '{text.URL}') AS url_ok,
               regexp_matches(uid, '{text.UUID}') AS uuid_ok, regexp_matches(url, '{text.UUID}') AS url_is_uuid,
               NOT regexp_matches(upper(word), '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS upper_ok,
               NOT regexp_matches(url, '[\\p{{Lu}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS lower_ok,
               regexp_matches(word, '^\\p{{Nd}}*$') AS digits, regexp_matches(word, '^\\p{{L}}*$') AS letters,
               regexp_matches(url, '^[\\p{{L}}\\p{{Nd}}]*$') AS alnum
        FROM x""",
)
def fn_checks(t):
    digest = F.md5("html")
    bounds = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    pages = t.pages.select(
        "page_id",
        "url",
        F.concat_ws("-", *[F.substring(digest, a, n) for a, n in bounds]).alias("uid"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("user"), "page_id", F.lit("@example.org")))
        .otherwise(F.col("url"))
        .alias("mail"),
        F.regexp_extract("url", "/([a-z0-9]+)", 1).alias("word"),
    )
    return pages.select(
        "page_id",
        text.is_email(F.col("mail")).alias("email"),
        text.is_url(F.col("url")).alias("url_ok"),
        text.is_uuid(F.col("uid")).alias("uuid_ok"),
        text.is_uuid(F.col("url")).alias("url_is_uuid"),
        text.is_upper(F.upper("word")).alias("upper_ok"),
        text.is_lower(F.col("url")).alias("lower_ok"),
        text.is_digit(F.col("word")).alias("digits"),
        text.is_alpha(F.col("word")).alias("letters"),
        text.is_alphanumeric(F.col("url")).alias("alnum"),
    )


@query(
    "fn_convert",
    """WITH x AS (SELECT event_id, props, value, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR)
                                                ELSE event_type END AS raw,
                         CASE event_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'false' WHEN 2 THEN '1' ELSE 'yes' END AS flag
                  FROM events)
       SELECT event_id, TRY_CAST(raw AS BIGINT) AS as_int, TRY_CAST(raw AS DOUBLE) AS as_float,
              CASE WHEN flag IN ('T', '1') THEN true WHEN flag = 'false' THEN false END AS as_bool,
              CAST(event_id AS VARCHAR) AS int_text, CAST(event_id % 2 = 0 AS VARCHAR) AS bool_text,
              decode(encode(props)) AS bytes_round
       FROM x""",
)
def fn_convert(t):
    even = F.col("event_id") % 2 == 0
    flags = F.array(*[F.lit(v) for v in ("T", "false", "1", "yes")])
    raw = F.when(even, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    flag = F.element_at(flags, (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select(
        "event_id",
        values.to_integer(raw).alias("as_int"),
        values.to_float(raw).alias("as_float"),
        values.to_boolean(flag).alias("as_bool"),
        F.col("event_id").cast("string").alias("int_text"),
        even.cast("string").alias("bool_text"),
        F.decode(F.encode("props", "UTF-8"), "UTF-8").alias("bytes_round"),
    )


@query(
    "fn_math",
    """SELECT c_custkey, least(c_acctbal, 500.0) AS smaller, greatest(c_acctbal, 500.0) AS larger,
              abs(c_acctbal) AS absolute, least(greatest(c_acctbal, 0.0), 1000.0) AS clamped,
              CAST(trunc(c_acctbal + 0.5) AS BIGINT) AS rounded,
              trunc(c_acctbal * 10.0 + 0.5) / 10.0 AS rounded_1
       FROM customer""",
)
def fn_math(t):
    c = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        values.smaller(c, F.lit(500.0)).alias("smaller"),
        values.larger(c, F.lit(500.0)).alias("larger"),
        F.abs(c).alias("absolute"),
        values.clamp(c, 0.0, 1000.0).alias("clamped"),
        values.round_half_up(c).alias("rounded"),
        values.round_places(c, 1).alias("rounded_1"),
    )


@query(
    "fn_array",
    """WITH x AS (SELECT c_custkey, string_split(CAST(c_custkey AS VARCHAR), '') AS digits FROM customer)
       SELECT c_custkey, list_contains(digits, '7') AS has_seven, array_to_string(list_sort(list_distinct(digits)), '') AS uniq,
              array_to_string(list_filter(digits, lambda d: d > '4'), '') AS big,
              array_to_string(list_transform(digits, lambda d: d || '0'), ',') AS tens
       FROM x""",
)
def fn_array(t):
    digits = F.filter(F.split(F.col("c_custkey").cast("string"), ""), lambda d: d != "")
    return t.customer.select("c_custkey", digits.alias("digits")).select(
        "c_custkey",
        F.array_contains("digits", "7").alias("has_seven"),
        F.array_join(F.array_sort(F.array_distinct("digits")), "").alias("uniq"),
        F.array_join(F.filter("digits", lambda d: d > "4"), "").alias("big"),
        F.array_join(F.transform("digits", lambda d: F.concat(d, F.lit("0"))), ",").alias("tens"),
    )


@query(
    "fn_map",
    """SELECT p_partkey, 'brand=' || p_brand || ',name=' || p_name || ',type=' || p_type AS as_map,
              'brand=' || p_brand || ',name=' || upper(p_name) || ',size=' || p_size || ',type=' || p_type AS merged,
              'brand,name,type' AS keys, p_name || '|' || p_type || '|' || p_brand AS vals,
              true AS has_name, false AS has_size, 'brand=' || p_brand || ',type=' || p_type AS without_name,
              '' AS missing
       FROM part""",
)
def fn_map(t):
    first = F.map_from_arrays(F.array(F.lit("name"), F.lit("type"), F.lit("brand")), F.array("p_name", "p_type", "p_brand"))
    second = F.create_map(F.lit("name"), F.upper("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", first.alias("m"), second.alias("n")).select(
        "p_partkey",
        values.sorted_pairs(F.col("m")).alias("as_map"),
        values.sorted_pairs(values.merge_maps(F.col("m"), F.col("n"))).alias("merged"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"),
        F.array_join(F.map_values("m"), "|").alias("vals"),
        F.map_contains_key("m", "name").alias("has_name"),
        F.map_contains_key("m", "size").alias("has_size"),
        values.sorted_pairs(values.without_key(F.col("m"), "name")).alias("without_name"),
        values.map_text(F.col("m"), "colour").alias("missing"),
    )


@query(
    "fn_json",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS record_json,
              json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_value,
              CASE WHEN event_type = 'error' THEN '' ELSE '{"service":"' || event_type || '"}' END AS context_text
       FROM events""",
)
def fn_json(t):
    context = F.when(F.col("event_type") != "error", F.create_map(F.lit("service"), F.col("event_type")))
    return t.events.select(
        "event_id",
        F.to_json(F.struct("event_id", "event_type")).alias("record_json"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.from_json("props", "k BIGINT")["k"].alias("k_value"),
        values.context_text(context).alias("context_text"),
    )
