"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as white space and as a well-formed value.
SPACE = r"[\s\x0B\x{85}\p{Z}]"
SPACE_CHARS = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
URL = r"^https?://[^\s/$.?#].[^\s]*\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def split_on(c: Column, separator: str, limit: int = -1) -> Column:
    """Split at a literal separator; ``limit`` bounds the number of pieces, and 0 gives none."""
    if limit == 0:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    quoted = "".join(f"\\{ch}" if ch in r"\.[]{}()*+-?^$|" else ch for ch in separator)
    return F.split(c, quoted, limit)


def trim_space(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def trim_left(c: Column, chars: str) -> Column:
    return F.ltrim(c, F.lit(chars))


def trim_right(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def count_of(c: Column, piece: str) -> Column:
    """Occurrences of ``piece`` that do not overlap; an empty piece counts the gaps between characters."""
    if piece == "":
        return (F.char_length(c) + 1).cast("bigint")
    removed = F.char_length(c) - F.char_length(F.replace(c, F.lit(piece), F.lit("")))
    return (removed / F.lit(len(piece))).cast("bigint")


def contains_any(c: Column, chars: str) -> Column:
    if not chars:
        return F.lit(False)
    return c.rlike("[" + "".join(re.escape(ch) for ch in chars) + "]")


def is_blank(c: Column) -> Column:
    return trim_space(c) == ""


def or_default(c: Column, default) -> Column:
    """The default for null, for an empty string and for the number zero."""
    empty = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(c, F.lit(empty)), F.lit(default))


def truncate(c: Column, length: int) -> Column:
    """Cut to ``length`` characters and mark the cut; shorter text is kept as it is."""
    return F.when(F.char_length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, length), F.lit("...")))


def pad_left(c: Column, length: int, char: str) -> Column:
    return F.when(F.char_length(c) >= length, c).otherwise(F.lpad(c, length, char))


def pad_right(c: Column, length: int, char: str) -> Column:
    return F.when(F.char_length(c) >= length, c).otherwise(F.rpad(c, length, char))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def _title(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.char_length(word))))


def pascal_case(c: Column) -> Column:
    return F.array_join(F.transform(_words(c), _title), "")


def camel_case(c: Column) -> Column:
    joined = F.transform(_words(c), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_title(w)))
    return F.array_join(joined, "")


def snake_case(c: Column) -> Column:
    """An underscore before every capital but a leading one, then lower case."""
    rest = F.regexp_replace(c.substr(F.lit(2), F.char_length(c)), r"(\p{Lu})", "_$1")
    return F.lower(F.concat(F.substring(c, 1, 1), rest))


def kebab_case(c: Column) -> Column:
    return F.replace(snake_case(c), F.lit("_"), F.lit("-"))


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def is_url(c: Column) -> Column:
    return c.rlike(URL)


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def is_upper(c: Column) -> Column:
    """No letter that is not upper case; true for text without letters."""
    return ~c.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def is_lower(c: Column) -> Column:
    return ~c.rlike(r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]")


def is_digit(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}*\z")


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}*\z")


def is_alphanumeric(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{Nd}]*\z")
