"""File typing, content sniffing, text statistics, image sizes, chunking and transfer accounting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.sources.files import extension

# File types by extension; anything else is unknown.
TYPE_OF_EXTENSION = {
    ".pdf": "pdf",
    ".doc": "word", ".docx": "word",
    ".xls": "excel", ".xlsx": "excel",
    ".ppt": "powerpoint", ".pptx": "powerpoint",
    ".md": "markdown", ".markdown": "markdown",
    ".html": "html", ".htm": "html",
    ".png": "png",
    ".jpg": "jpg", ".jpeg": "jpg",
    ".gif": "gif",
    ".bmp": "bmp",
    ".tiff": "tiff", ".tif": "tiff",
    ".webp": "webp",
}
SUPPORTED = tuple(dict.fromkeys(TYPE_OF_EXTENSION.values()))
CHUNK_BYTES = 65_536
STREAM_BUFFER_BYTES = 8_192
BATCH_RECORDS = 1_024
FRAME_BYTES = 8


def file_type(path: Column) -> Column:
    pairs = [F.lit(x) for pair in TYPE_OF_EXTENSION.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def can_process(kind: Column) -> Column:
    return kind.isin(*SUPPORTED)


def sniff(content: Column, kind: Column) -> Column:
    """What the bytes of a file of a type look like: text that stands for it, and whether they fit.

    ``struct<text string, fits boolean>``; ``fits`` is null for types without a signature.
    """
    data = content.cast("binary")
    head = F.hex(F.substring(data, 1, 4))
    size = F.octet_length(data)
    zipped, old_office = F.startswith(head, F.lit("504B")), head == "D0CF11E0"
    raw = F.make_valid_utf8(data.cast("string"))

    def label(words: str) -> Column:
        return F.format_string(f"[{words} - %d bytes]", size)

    pdf = head.isin("25504446", "25706466")
    text = (
        F.when((kind == "pdf") & pdf, label("PDF content"))
        .when((kind == "word") & zipped, label("Word document"))
        .when((kind == "word") & old_office, label("Word document (legacy)"))
        .when((kind == "excel") & zipped, label("Excel spreadsheet"))
        .when((kind == "powerpoint") & zipped, label("PowerPoint presentation"))
        .otherwise(raw)
    )
    markup = F.contains(raw, F.lit("<!DOCTYPE")) | F.contains(raw, F.lit("<html"))
    fits = (
        F.when(kind == "pdf", pdf)
        .when(kind == "word", zipped | old_office)
        .when(kind.isin("excel", "powerpoint"), zipped)
        .when(kind == "html", markup)
    )
    return F.struct(text.alias("text"), fits.alias("fits"))


def line_count(text: Column) -> Column:
    """Pieces between line feeds; empty text is one line."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def _number(content: Column, first: int, length: int, little: bool) -> Column:
    digits = F.hex(F.substring(content, first, length))
    if little:
        pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(length))]
        digits = F.concat(*pairs)
    return F.conv(digits, 16, 10).cast("bigint")


def _signed32(c: Column) -> Column:
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c)


def header_size(content: Column, kind: Column) -> Column:
    """Width and height of PNG, GIF and BMP images from their headers, null where they cannot be read."""
    data = content.cast("binary")
    head = F.hex(F.substring(data, 1, 8))
    size = F.octet_length(data)
    png = (kind == "png") & (head == "89504E470D0A1A0A") & (F.hex(F.substring(data, 13, 4)) == "49484452") & (size >= 24)
    gif = (kind == "gif") & head.rlike("^474946383[79]61") & (size >= 10)
    bmp = (kind == "bmp") & (size >= 54)
    width = (
        F.when(png, _number(data, 17, 4, False))
        .when(gif, _number(data, 7, 2, True))
        .when(bmp, _signed32(_number(data, 19, 4, True)))
    )
    height = (
        F.when(png, _number(data, 21, 4, False))
        .when(gif, _number(data, 9, 2, True))
        .when(bmp, _signed32(_number(data, 23, 4, True)))
    )
    return F.struct(width.alias("width"), height.alias("height"))


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Size from the first frame header of a JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def jpeg_sizes(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, width, height)`` of JPEG images; a JPEG header has no fixed place, so it is walked."""
    kind = images.schema[key].dataType.simpleString()

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_jpeg_size(bytes(b)) or (None, None) for b in batch[content]]
            frame = pd.DataFrame(found, columns=["width", "height"]).astype("Int64")
            frame.insert(0, key, batch[key].to_numpy())
            yield frame

    return images.select(key, content).mapInPandas(sizes, f"{key} {kind}, width bigint, height bigint")


def image_text(kind: Column, width: Column, height: Column, size: Column) -> Column:
    """Line that stands for an image."""
    names = {"png": "PNG", "jpg": "JPEG", "gif": "GIF", "bmp": "BMP", "tiff": "TIFF", "webp": "WebP"}
    name = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), kind)
    sized = F.format_string("[%s image %dx%d - %d bytes]", name, width, height, size)
    plain = F.format_string("[%s image - %d bytes]", name, size)
    short_bmp = F.lit("[BMP image - insufficient data]")
    return F.when((kind == "bmp") & (size < 54), short_bmp).when(width.isNotNull(), sized).otherwise(plain)


def size_capped(files: DataFrame, content: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Files small enough to process, and those that are not."""
    small = F.octet_length(content) <= limit
    return files.where(small), files.where(~small)


def chunks(df: DataFrame, key: str, content: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Numbered pieces of at most ``size`` bytes; empty content has none.

    The pieces are cut before they become rows, so no row carries the whole content.
    """
    data = F.col(content).cast("binary")
    pieces = F.ceil(F.octet_length(content) / F.lit(size)).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), pieces), lambda i: i < pieces)
    cut = F.transform(numbers, lambda i: F.substring(data, i * size + 1, F.lit(size)))
    return df.select(key, F.posexplode(cut).alias("chunk_no", "chunk"))


def stream_bytes(payload: Column) -> Column:
    """Bytes of one streamed record: its payload and a frame."""
    return F.octet_length(payload) + F.lit(FRAME_BYTES)


def stream_totals(df: DataFrame, payload: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.sum(stream_bytes(F.col(payload)).cast("bigint")).alias("bytes")
    )


def batch_totals(
    df: DataFrame, payload: str, order_by: str, slice_by: Column | None = None, batch_size: int = BATCH_RECORDS
) -> DataFrame:
    """Records and bytes of each batch: payloads of ``batch_size`` records in order and one frame.

    The last batch may be short. Without ``slice_by`` the slices follow the sizes that a first job observes, so
    scattered and crowded ids cost the same.
    """
    sized = df.select(order_by, F.octet_length(payload).cast("bigint").alias("__size"))
    slices = ordering.observed_slice(df, order_by) if slice_by is None else slice_by
    placed = ordering.numbered(sized, [F.col(order_by)], slices)
    batch = F.floor((F.col("position") - 1) / F.lit(batch_size)).alias("batch")
    return placed.groupBy(batch).agg(
        F.count(F.lit(1)).alias("records"), (F.sum("__size") + FRAME_BYTES).alias("bytes")
    )


def hybrid_totals(
    df: DataFrame, payload: str, order_by: str, slice_by: Column | None, threshold: int, batch_size: int = BATCH_RECORDS
) -> DataFrame:
    """Large records go in batches, the others are streamed one by one."""
    large = F.octet_length(payload) > threshold
    batched = batch_totals(df.where(large), payload, order_by, slice_by, batch_size)
    streamed = stream_totals(df.where(~large), payload)
    return (
        batched.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("messages"))
        .select(F.lit("batch").alias("route"), "records", "bytes", "messages")
        .unionByName(streamed.select(F.lit("stream").alias("route"), "records", "bytes", F.col("records").alias("messages")))
    )


def storage_usage(files: DataFrame, content: str, capacity: int, *keys: str) -> DataFrame:
    """Stored bytes and their share of the capacity in percent."""
    used = files.groupBy(*keys).agg(F.sum(F.octet_length(content).cast("bigint")).alias("bytes"))
    return used.withColumn("usage_percent", F.col("bytes") / F.lit(capacity) * 100)
