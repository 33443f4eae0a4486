"""Log search, levels, facets and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels in rank order with the spellings that read as each; any other text reads as INFO.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
SPELLINGS = {
    "DEBUG": ("DEBUG", "debug"),
    "INFO": ("INFO", "info"),
    "WARN": ("WARN", "warn", "WARNING", "warning"),
    "ERROR": ("ERROR", "error"),
    "FATAL": ("FATAL", "fatal"),
}


#: Column of a stored log table: minutes since 1970, whose statistics readers compare.
MINUTE = "minute"


def level_rank(text: Column) -> Column:
    ranked = F.lit(LEVELS.index("INFO"))
    for name in LEVELS:
        ranked = F.when(text.isin(*SPELLINGS[name]), F.lit(LEVELS.index(name))).otherwise(ranked)
    return ranked


def at_least(logs: DataFrame, level: str, column: str = "level") -> DataFrame:
    """Entries at or above a level."""
    threshold = next((LEVELS.index(n) for n in LEVELS if level in SPELLINGS[n]), LEVELS.index("INFO"))
    return logs.where(level_rank(F.col(column)) >= threshold)


def search(
    logs: DataFrame,
    start: str | None = None,
    end: str | None = None,
    contains: str | None = None,
    last: int | None = None,
    order_by: str = "log_id",
    **equals,
) -> DataFrame:
    """Entries that match all given criteria: equal fields, an inclusive time range and a piece of the
    message. ``last`` keeps the newest entries only, in the order of arrival. A log table partitioned by
    ``day`` is read only for the days of the range, and one that ``store`` wrote only for row groups that
    may hold the ids and minutes."""
    found = logs
    if MINUTE in logs.columns:
        for edge, keep in ((start, "__ge__"), (end, "__le__")):
            if edge is not None:
                minute = F.floor(F.unix_seconds(F.lit(edge).cast("timestamp_ntz").cast("timestamp")) / 60)
                found = found.where(getattr(F.col(MINUTE), keep)(minute))
    for name, wanted in equals.items():
        if wanted not in (None, ""):
            found = found.where(F.col(name) == wanted)
    if start is not None:
        found = found.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
        if "day" in logs.columns:
            found = found.where(F.col("day") >= F.to_date(F.lit(start)))
    if end is not None:
        found = found.where(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
        if "day" in logs.columns:
            found = found.where(F.col("day") <= F.to_date(F.lit(end)))
    if contains:
        found = found.where(F.contains(F.col("message"), F.lit(contains)))
    if last:
        found = found.orderBy(F.col(order_by).desc()).limit(last).orderBy(order_by)
    return found


def store(logs: DataFrame, path: str, ids: Sequence[str], mode: str = "append", group_bytes: int = 8 << 20, distinct: int = 100_000) -> None:
    """Write logs so that a search skips most of them.

    Folders by ``day``; in a day, ranges of (first id, time) make the files and their order, so that the least and
    greatest value of a row group tell which ids and minutes it may hold. Row groups are small, and each has a Bloom
    filter for every column of ``ids`` (about ``distinct`` values a file), so that a search by an id that doesn't lead
    the order skips too. A busy day is many ranges, never one task.
    """
    stamped = logs.withColumns({"day": F.to_date("timestamp"), MINUTE: F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 60)})
    order = ["day", ids[0], "timestamp"]
    writer = stamped.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day")
    writer = writer.option("parquet.block.size", group_bytes).option("parquet.block.row.count.limit", max(100, group_bytes // 100))
    for name in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", distinct)
    writer.parquet(path)


def facets(logs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Entries per value of each field, all fields from one scan."""
    sets = [[F.col(f)] for f in fields]
    return logs.groupingSets(sets, *fields).agg(F.count(F.lit(1)).alias("entries"))


def retained(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Entries young enough to keep, with the day that partitions the log table."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    kept = logs.where(F.col("timestamp") >= oldest)
    if "day" in logs.columns:
        return kept.where(F.col("day") >= F.to_date(oldest))
    return kept.withColumn("day", F.to_date("timestamp"))
