"""Dates and durations. Everything relative to "now" takes the moment as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def format_time(c: Column, pattern: str = "") -> Column:
    """Format a time; without a pattern the RFC 3339 form in UTC."""
    return F.date_format(c, pattern or "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def format_datetime(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def parse_time(text: Column, pattern: str = "") -> Column:
    """Parse a time, null when the text does not fit."""
    return ntz(F.try_to_timestamp(text, F.lit(pattern or "yyyy-MM-dd'T'HH:mm:ssX")))


def parse_in_zone(text: Column, pattern: str, zone: str) -> Column:
    """Parse wall-clock text of ``zone`` to UTC."""
    return ntz(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000)


def milliseconds_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, cut towards zero."""
    return ((micros(end) - micros(start)) / F.lit(1000)).cast("bigint")


def days_between(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours, cut towards zero; not calendar days."""
    return ((micros(end) - micros(start)) / F.lit(MICROS_PER_DAY)).cast("bigint")


def add_calendar(c: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """Calendar addition. A day past the end of the month becomes the last day of that month."""
    return c + F.make_interval(years=F.lit(years), months=F.lit(months), days=F.lit(days))


def add_seconds(c: Column, seconds: float) -> Column:
    return c + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def begin_of(unit: str, c: Column) -> Column:
    """Start of the ``day``, ``week`` (Monday), ``month`` or ``year``."""
    return ntz(F.date_trunc(unit, c))


def end_of(unit: str, c: Column) -> Column:
    """Last microsecond of the unit."""
    step = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "year": "1 YEAR"}[unit]
    return begin_of(unit, c) + F.expr(f"INTERVAL {step}") - F.expr("INTERVAL 0.000001 SECOND")


def same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def day_offset_is(c: Column, as_of: Column, days: int) -> Column:
    """True if ``c`` falls ``days`` after the day of ``as_of``: 0 today, -1 yesterday, 1 tomorrow."""
    return F.to_date(c) == F.date_add(F.to_date(as_of), days)
