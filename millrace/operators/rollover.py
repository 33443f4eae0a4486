"""Rollover: log segments that end with the day or as soon as their bytes are reached.

Where a segment begins depends on where the one before it began, back to the first entry of the day. No task walks that
chain through a whole day: bytes are cut into blocks, each block tells for every place at which a cut may enter it where
the next cut leaves it (its *jump table*), and only the tables are put together, one row after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.session import scratch

#: Day of the entries without a time, in days since 1970.
NO_DAY = -(1 << 31)


def _placed(logs: DataFrame, order_by: list[str], size: Column, slice_by: Column) -> DataFrame:
    """Narrow rows: day number, order, size, place within the day (from 1) and bytes before; shuffled once."""
    day = F.coalesce(F.unix_date(F.to_date(F.col(order_by[0]))), F.lit(NO_DAY))
    at_least_one = F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(1)).cast("bigint")
    rows = ordering.sliced(logs.select(day.alias("_day"), *order_by, at_least_one.alias("_size")), ["_day"], slice_by)
    totals = rows.groupBy(ordering.KEY).agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_entries"))
    ahead = ordering.across(["_day"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(ordering.KEY, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_bytes", "_entries")])
    window = ordering.within([F.col(c) for c in (*order_by, "_size")])
    upto = F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumns({"_place": F.row_number().over(window), "_upto": upto})
    before = F.col("_upto") - F.col("_size") + F.col("_bytes")
    return local.join(carried, ordering.KEY).select("_day", *order_by, "_size", (F.col("_place") + F.col("_entries")).alias("_place"), before.alias("_before"))


def _next_cuts(places: np.ndarray, limit: int) -> np.ndarray:
    """Index of the cut after a cut at each place; the number of places where it lies beyond them."""
    return np.searchsorted(places, places + limit)


def jump_table(places: np.ndarray, limit: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts leave a block that begins at byte ``start``: a cut due at byte t falls on the first of the sorted ``places``
    not before t. For the first row with ``upto`` >= t, ``due`` is the byte at which the first cut after the block is due."""
    n = len(places)
    last = np.minimum(_next_cuts(places, limit), n)
    last = np.where(last < n, last, np.arange(n))
    while not np.array_equal(further := last[last], last):
        last = further
    entries = min(n, int(np.searchsorted(places, start + limit - 1)) + 1)
    due = places[last[:entries]] + limit
    ends = np.append(due[1:] != due[:-1], True)
    return places[:entries][ends], due[ends]


def rollover(logs: DataFrame, limit: int, size: Column, order_by: list[str], slice_by: Column, block_entries: int = 1 << 18) -> DataFrame:
    """Segments of the logs: ``day``, ``segment`` (from 1 within the day), ``first_*`` and ``last_*`` of every column of
    ``order_by``, ``entries``, ``bytes``.

    In ``order_by`` (a time first) an entry opens a segment if its day begins with it, or if the open segment has ``limit``
    bytes or more. ``size`` counts as 1 at least, null too. Entries that tie in everything are alike; entries without a time
    make segments of day null; no entries make no segments. Other columns are not read.

    Cuts can't fall just anywhere: the k-th one falls between k * limit and k * (limit + largest - 1) bytes into the day, as
    each is late by less than an entry. Only those candidates go into blocks of about ``block_entries`` entries, or ``limit``
    bytes if that is more. The tables of a day's blocks meet in one task: for each block at most its candidates within the
    first ``limit`` bytes, mostly far fewer, because cuts run together. So do the days' cuts, to be numbered.
    """
    if limit < 1:
        raise ValueError("a segment has one byte at least")
    spark = logs.sparkSession
    path = scratch(spark, "placed")
    _placed(logs, order_by, size, slice_by).write.parquet(path)
    placed = spark.read.parquet(path)
    days = placed.groupBy("_day").agg(
        F.max("_size").alias("_largest"), F.max(F.col("_before") + F.col("_size")).alias("_total"), F.max("_place").alias("_entries")
    )
    width = F.greatest(F.lit(limit).cast("bigint"), (F.col("_total") / F.col("_entries") * block_entries).cast("bigint"))
    possible = F.expr(f"_before div {limit}L >= (_before + {limit}L + _largest - 2) div ({limit}L + _largest - 1)")
    candidates = (
        placed.select("_day", "_before").join(days.select("_day", "_largest", width.alias("_width")), "_day").where(possible)
        .select("_day", F.expr("_before div _width").alias("_block"), "_width", "_before")
    )

    def tables(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        upto, due = jump_table(np.sort(rows["_before"].to_numpy()), limit, int(key[1]) * int(rows["_width"].iloc[0]))
        return pd.DataFrame({"_day": key[0], "_block": key[1], "_upto": upto, "_due": due})

    def entered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_block", "_upto"])
        upto, due = rows["_upto"].to_numpy(), rows["_due"].to_numpy()
        blocks, lows = np.unique(rows["_block"].to_numpy(), return_index=True)
        at, begun = 0, np.empty(len(blocks), np.int64)
        for k, (low, high) in enumerate(zip(lows, np.append(lows[1:], len(rows)))):
            begun[k] = at
            hit = low + np.searchsorted(upto[low:high], at)
            at = due[hit] if hit < high else at
        return pd.DataFrame({"_day": key[0], "_block": blocks, "_at": begun})

    def cuts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        places = np.sort(rows["_before"].to_numpy())
        following, found = _next_cuts(places, limit), []
        k = int(np.searchsorted(places, rows["_at"].iloc[0]))
        while k < len(places):
            found.append(places[k])
            k = following[k]
        return pd.DataFrame({"_day": key[0], "_from": np.array(found, np.int64)})

    jumps = candidates.groupBy("_day", "_block").applyInPandas(tables, "_day int, _block long, _upto long, _due long")
    begun = jumps.groupBy("_day").applyInPandas(entered, "_day int, _block long, _at long")
    found = candidates.join(begun, ["_day", "_block"]).groupBy("_day", "_block").applyInPandas(cuts, "_day int, _from long")

    along = Window.partitionBy("_day").orderBy("_from")
    segments = found.join(days.select("_day", "_total"), "_day").select(
        "_day", F.row_number().over(along).cast("bigint").alias("segment"), "_from", F.coalesce(F.lead("_from").over(along), "_total").alias("_to")
    )
    opened = placed.select("_day", F.col("_before").alias("_from"), F.col("_place").alias("_first"), *[F.col(c).alias(f"first_{c}") for c in order_by])
    ended = placed.select("_day", (F.col("_before") + F.col("_size")).alias("_to"), F.col("_place").alias("_last"), *[F.col(c).alias(f"last_{c}") for c in order_by])
    day = F.when(F.col("_day") != NO_DAY, F.date_from_unix_date("_day"))
    return segments.join(opened, ["_day", "_from"]).join(ended, ["_day", "_to"]).select(
        day.alias("day"), "segment", *[f"{side}_{c}" for side in ("first", "last") for c in order_by],
        (F.col("_last") - F.col("_first") + 1).cast("bigint").alias("entries"), (F.col("_to") - F.col("_from")).alias("bytes"),
    )
