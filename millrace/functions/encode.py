"""Hashes and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The checksum algorithms a record or file may be checked with, by each of their names.
ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256"}


def checksum(data: Column, algorithm: str) -> Column:
    """Lower-case hex digest; names of algorithms ignore case, an unknown one is an error."""
    name = ALGORITHMS.get(algorithm.lower())
    if name is None:
        raise ValueError(f"unsupported checksum algorithm {algorithm!r}, expected one of {sorted(ALGORITHMS)}")
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[name](data)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def to_base64(data: Column) -> Column:
    """Base64 on one line; Spark's own function breaks lines after 76 characters."""
    return F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def to_url_base64(data: Column) -> Column:
    return F.replace(F.replace(to_base64(data), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def from_url_base64(text: Column) -> Column:
    return F.unbase64(F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")))


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in byte order."""
    left, right = a.cast("binary"), b.cast("binary")
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


# Fixed values of the published 64-bit FNV-1a hash, split in 32-bit halves; the prime is 2**40 + 435.
FNV_OFFSET_HIGH = 0xCBF29CE4
FNV_OFFSET_LOW = 0x84222325
FNV_PRIME_LOW = 435
WORD = 0xFFFFFFFF


def fnv1a_words(text: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes as ``struct<high, low>`` of unsigned 32-bit words.

    The hash is kept in two words because 64-bit products overflow, which ANSI mode reports as an error.
    """
    pairs = F.regexp_extract_all(F.hex(text), F.lit("[0-9A-F]{2}"), F.lit(0))
    octets = F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("bigint"))
    start = F.struct(F.lit(FNV_OFFSET_HIGH).cast("bigint").alias("high"), F.lit(FNV_OFFSET_LOW).cast("bigint").alias("low"))

    def mix(state: Column, octet: Column) -> Column:
        mixed = state["low"].bitwiseXOR(octet)
        product = mixed * F.lit(FNV_PRIME_LOW).cast("bigint")
        high = state["high"] * F.lit(FNV_PRIME_LOW).cast("bigint") + F.shiftleft(mixed, 8) + F.shiftright(product, 32)
        return F.struct(
            high.bitwiseAND(F.lit(WORD)).alias("high"), product.bitwiseAND(F.lit(WORD)).alias("low")
        )

    return F.aggregate(octets, start, mix)


def fnv1a_hex(text: Column) -> Column:
    return F.aggregate(
        F.array(fnv1a_words(text)),
        F.lit(""),
        lambda done, w: F.concat(done, F.lpad(F.hex(w["high"]), 8, "0"), F.lpad(F.hex(w["low"]), 8, "0")),
        F.lower,
    )


def fnv1a_mod(text: Column, n: int) -> Column:
    """FNV-1a 64 modulo ``n``."""
    words = fnv1a_words(text)
    return F.aggregate(
        F.array(words),
        F.lit(0).cast("bigint"),
        lambda _, w: (F.pmod(w["high"], F.lit(n)) * F.lit((1 << 32) % n) + F.pmod(w["low"], F.lit(n))) % F.lit(n),
    )
