"""Queries over files, documents and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import encode
from millrace.operators import documents, joins, validation
from millrace.plans.registry import query
from millrace.session import scratch
from millrace.sources import files, sinks

_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\.[^.]*)$', 1))"
_TYPES = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in documents.TYPE_OF_EXTENSION.items())


@query(
    "file_type",
    f"""WITH f AS (SELECT file_id, path FROM page_files UNION ALL SELECT file_id, path FROM document_files)
        SELECT file_id, path, CASE {_EXT} {_TYPES} ELSE 'unknown' END AS kind,
               CASE {_EXT} {_TYPES} ELSE 'unknown' END <> 'unknown' AS supported
        FROM f""",
)
def file_type(t):
    paths = t.page_files.select("file_id", "path").unionByName(t.document_files.select("file_id", "path"))
    typed = paths.withColumn("kind", documents.file_type(F.col("path")))
    return typed.withColumn("supported", documents.can_process(F.col("kind")))


_KINDS = "['pdf', 'word', 'excel', 'powerpoint', 'html', 'markdown']"
_RAW = f"""SELECT file_id, {_KINDS}[CAST(file_id % 6 AS BIGINT) + 1] AS kind,
                  CASE file_id % 5 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'PK' WHEN 2 THEN '%pdf' ELSE '' END || content AS content
           FROM page_files"""


@query(
    "file_sniff",
    f"""WITH x AS ({_RAW})
        SELECT file_id, kind,
               CASE WHEN kind = 'pdf' AND (starts_with(content, '%PDF') OR starts_with(content, '%pdf'))
                        THEN '[PDF content - ' || strlen(content) || ' bytes]'
                    WHEN kind = 'word' AND starts_with(content, 'PK') THEN '[Word document - ' || strlen(content) || ' bytes]'
                    WHEN kind = 'excel' AND starts_with(content, 'PK') THEN '[Excel spreadsheet - ' || strlen(content) || ' bytes]'
                    WHEN kind = 'powerpoint' AND starts_with(content, 'PK')
                        THEN '[PowerPoint presentation - ' || strlen(content) || ' bytes]' ELSE content END AS text,
               CASE WHEN kind = 'pdf' THEN starts_with(content, '%PDF') OR starts_with(content, '%pdf')
                    WHEN kind IN ('word', 'excel', 'powerpoint') THEN starts_with(content, 'PK')
                    WHEN kind = 'html' THEN contains(content, '<!DOCTYPE') OR contains(content, '<html') END AS fits
        FROM x""",
)
def file_sniff(t):
    kinds = F.array(*[F.lit(k) for k in ("pdf", "word", "excel", "powerpoint", "html", "markdown")])
    turn = F.col("file_id") % 5
    head = F.when(turn == 0, "%PDF-1.7 ").when(turn == 1, "PK").when(turn == 2, "%pdf").otherwise("")
    raw = t.page_files.select(
        "file_id", F.get(kinds, (F.col("file_id") % 6).cast("int")).alias("kind"), F.concat(head, "content").alias("content")
    )
    return raw.select("file_id", "kind", documents.sniff(F.col("content"), F.col("kind")).alias("s")).select(
        "file_id", "kind", "s.text", "s.fits"
    )


@query(
    "text_stats",
    "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count, strlen(text) AS char_count FROM documents",
)
def text_stats(t):
    return t.documents.select(
        "doc_id",
        documents.line_count(F.col("text")).alias("line_count"),
        F.octet_length("text").cast("bigint").alias("char_count"),
    )


@query(
    "image_sizes",
    """SELECT p_partkey AS file_id, ['png', 'gif', 'bmp', 'jpg'][CAST(p_partkey % 4 AS BIGINT) + 1] AS kind,
              CAST(p_size * 7 AS BIGINT) AS width, CAST(p_partkey % 5000 + 1 AS BIGINT) AS height
       FROM part""",
)
def image_sizes(t):
    """Headers written from the columns of ``part`` and read again."""
    kinds = F.array(*[F.lit(k) for k in ("png", "gif", "bmp", "jpg")])
    wide, high = F.col("p_size") * 7, F.col("p_partkey") % 5000 + 1

    def big(number, n_bytes: int):
        return F.lpad(F.hex(number.cast("bigint")), 2 * n_bytes, "0")

    def little(number, n_bytes: int):
        return F.concat(*[F.substring(big(number, n_bytes), 2 * i + 1, 2) for i in reversed(range(n_bytes))])

    turn = F.col("p_partkey") % 4
    digits = (
        F.when(turn == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(wide, 4), big(high, 4)))
        .when(turn == 1, F.concat(F.lit("474946383961"), little(wide, 2), little(high, 2)))
        .when(turn == 2, F.concat(F.lit("424D" + "00" * 16), little(wide, 4), little(high, 4), F.lit("00" * 28)))
        .otherwise(F.concat(F.lit("FFD8FFC0001108"), big(high, 2), big(wide, 2)))
    )
    images = t.part.select(
        F.col("p_partkey").alias("file_id"), F.get(kinds, turn.cast("int")).alias("kind"), F.unhex(digits).alias("content")
    )
    jpeg = F.col("kind") == "jpg"
    plain = images.where(~jpeg).withColumn("size", documents.header_size(F.col("content"), F.col("kind")))
    walked = documents.jpeg_sizes(images.where(jpeg), "file_id").withColumn("kind", F.lit("jpg"))
    return plain.select("file_id", "kind", "size.*").unionByName(walked)


@query(
    "docs_size_capped",
    """SELECT file_id, path, strlen(content) AS size, CASE WHEN strlen(content) <= 4000 THEN 'processed' ELSE 'rejected' END AS outcome
       FROM document_files""",
)
def docs_size_capped(t):
    sized = t.document_files.withColumn("size", F.octet_length("content").cast("bigint"))
    small, large = documents.size_capped(sized, "content", 4000)
    columns = ["file_id", "path", "size"]
    return small.select(*columns, F.lit("processed").alias("outcome")).unionByName(
        large.select(*columns, F.lit("rejected").alias("outcome"))
    )


@query(
    "content_base64",
    "SELECT file_id, base64(encode(content)) AS encoded, content AS decoded FROM document_files",
)
def content_base64(t):
    encoded = encode.to_base64(F.col("content"))
    return t.document_files.select(
        "file_id",
        encoded.alias("encoded"),
        F.decode(encode.from_base64(encoded), "UTF-8").alias("decoded"),
    )


@query(
    "doc_chunks",
    """WITH h AS (SELECT doc_id, hex(encode(text)) AS digits, strlen(text) AS size FROM documents)
       SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, least(8192, size - i * 8192) AS n_bytes,
              md5(unhex(substring(digits, CAST(i * 16384 + 1 AS BIGINT), 16384))) AS digest
       FROM h, range(0, 100000) r(i) WHERE i * 8192 < size""",
)
def doc_chunks(t):
    pieces = documents.chunks(t.documents, "doc_id", "text", documents.STREAM_BUFFER_BYTES)
    return pieces.select(
        "doc_id", "chunk_no", F.octet_length("chunk").cast("bigint").alias("n_bytes"), F.md5("chunk").alias("digest")
    )


@query(
    "file_checksum",
    """WITH f AS (SELECT file_id, path, strlen(content) AS size, sha256(content) AS checksum FROM page_files)
       SELECT path, size, checksum, checksum = sha256(CASE WHEN file_id % 4 = 0 THEN content || ' ' ELSE content END) AS valid
       FROM f JOIN page_files USING (file_id, path)""",
)
def file_checksum(t):
    changed = F.when(F.col("file_id") % 4 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    expected = t.page_files.select("file_id", F.upper(F.sha2(changed, 256)).alias("checksum"))
    summed = validation.validate_checksum(t.page_files, "content", "sha256").select(
        "file_id", "path", "checksum", F.col("input_size").cast("bigint").alias("size")
    )
    return joins.reconcile_checksums(summed, expected, "file_id").select(
        "path", "size", F.col("actual").alias("checksum"), (F.col("verdict") == "match").alias("valid")
    )


@query(
    "file_bytes_checksum",
    """WITH f AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, c_nationkey || ',' || count(*) || ',' || sum(c_custkey) || chr(10) AS content
                  FROM customer GROUP BY c_nationkey)
       SELECT nation, strlen(content) AS size, sha256(content) AS checksum, nation % 4 <> 0 AS valid FROM f""",
)
def file_bytes_checksum(t):
    """Bytes of written files against the checksums of a manifest, in which every fourth is of another content."""
    path, nation = scratch(t.spark, "bytes"), F.col("c_nationkey").cast("bigint")
    totals = t.customer.groupBy(nation.alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))
    lines = totals.select("nation", F.concat_ws(",", "nation", "n", "total").alias("line"))
    sinks.write(lines, path, "text", partition_by=["nation"])
    sent = F.concat("line", F.when(F.col("nation") % 4 == 0, "\r\n").otherwise("\n"))
    manifest = lines.select("nation", F.upper(F.sha2(sent, 256)).alias("expected"))
    found = files.contents(t.spark, path).withColumn("nation", F.regexp_extract("path", "/nation=([0-9]+)/", 1).cast("bigint"))
    checked = validation.validate_checksum(found.join(manifest, "nation"), "content", "sha256", "expected")
    return checked.select("nation", "size", "checksum", "valid")


@query(
    "storage_usage",
    """SELECT parent, CAST(sum(strlen(content)) AS BIGINT) AS bytes, sum(strlen(content)) / 100000000 * 100 AS usage_percent
       FROM document_files GROUP BY parent""",
)
def storage_usage(t):
    return documents.storage_usage(t.document_files, "content", 100_000_000, "parent")


@query(
    "transfer_stream",
    """SELECT source, count(*) AS records, CAST(sum(strlen(text) + 8) AS BIGINT) AS bytes FROM documents GROUP BY source""",
)
def transfer_stream(t):
    return documents.stream_totals(t.documents, "text", "source")


@query(
    "transfer_batch",
    """WITH n AS (SELECT strlen(props) AS size, row_number() OVER (ORDER BY event_id) AS position FROM events)
       SELECT (position - 1) // 1024 AS batch, count(*) AS records, CAST(sum(size) + 8 AS BIGINT) AS bytes FROM n GROUP BY 1""",
)
def transfer_batch(t):
    return documents.batch_totals(t.events, "props", "event_id")


@query(
    "transfer_hybrid",
    """WITH n AS (SELECT strlen(text) AS size, row_number() OVER (ORDER BY doc_id) AS position FROM documents WHERE strlen(text) > 1500),
            b AS (SELECT (position - 1) // 64 AS batch, count(*) AS records, sum(size) + 8 AS bytes FROM n GROUP BY 1)
       SELECT 'batch' AS route, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS messages FROM b
       UNION ALL
       SELECT 'stream', count(*), CAST(sum(strlen(text) + 8) AS BIGINT), count(*) FROM documents WHERE strlen(text) <= 1500""",
)
def transfer_hybrid(t):
    return documents.hybrid_totals(t.documents, "text", "doc_id", None, 1500, 64)


@query(
    "transfer_throughput",
    """SELECT event_type, CAST(sum(strlen(props) + 8) AS BIGINT) AS bytes,
              sum(strlen(props) + 8) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS bytes_per_second
       FROM events GROUP BY event_type""",
)
def transfer_throughput(t):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1_000_000)
    sent = F.sum(documents.stream_bytes(F.col("props")).cast("bigint"))
    return t.events.groupBy("event_type").agg(sent.alias("bytes"), (sent / span).alias("bytes_per_second"))
