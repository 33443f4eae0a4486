"""Conversions, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that read as a boolean.
TRUE_TEXTS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_TEXTS = ("0", "f", "F", "FALSE", "false", "False")


def to_integer(c: Column) -> Column:
    """Digits with an optional sign, nothing else; null when the text is no integer."""
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))


def to_float(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^[+-]?(?i:inf|infinity)\z|^(?i:nan)\z"), c.try_cast("double"))


def to_boolean(c: Column) -> Column:
    return F.when(c.isin(*TRUE_TEXTS), F.lit(True)).when(c.isin(*FALSE_TEXTS), F.lit(False))


def clamp(c: Column, low, high) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def round_half_up(c: Column) -> Column:
    """Add a half and cut towards zero: 2.5 gives 3, -2.7 gives -2. Null beyond 64 bits and for NaN."""
    return (c + F.lit(0.5)).try_cast("bigint")


def round_places(c: Column, places: int) -> Column:
    scale = F.lit(float(10**places))
    return round_half_up(c * scale).cast("double") / scale


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two maps; the second wins."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def without_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_text(m: Column, key: str) -> Column:
    """Text under ``key``, empty when it is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def sorted_pairs(m: Column) -> Column:
    """A map as ``k=v`` text in key order."""
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.array_join(pairs, ",")


def context_text(context: Column) -> Column:
    """A context as JSON, empty when there is none."""
    return F.coalesce(F.to_json(context), F.lit(""))
