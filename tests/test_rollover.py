"""Segments of logs against a plain walk through the entries."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.operators.rollover import jump_table, rollover

DAY = datetime(2024, 1, 1)


def walked(rows, limit):
    """The rule itself, entry by entry."""
    days = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or DAY, r[1])):
        days[row[0] and row[0].date()].append(row)
    out = []
    for day, entries in days.items():
        open_ = []
        for at, number, size in entries:
            size = max(size or 0, 1)
            if not open_ or open_[-1][-1] >= limit:
                open_.append([at, number, at, number, 0, 0])
            last = open_[-1]
            last[2:] = at, number, last[4] + 1, last[5] + size
        out += [(day, n + 1, *segment) for n, segment in enumerate(open_)]
    return sorted(out, key=str)


def segments(spark, rows, limit, unit="hour", **settings):
    logs = spark.createDataFrame(rows, "timestamp timestamp_ntz, id long, size long").withColumn("segment", F.lit("other"))
    found = rollover(logs, limit, F.col("size"), ["timestamp", "id"], ordering.time_slice("timestamp", unit), **settings)
    assert found.columns == ["day", "segment", "first_timestamp", "first_id", "last_timestamp", "last_id", "entries", "bytes"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def entries(n, sizes, seconds, seed=1):
    chosen = random.Random(seed)
    return [(DAY + timedelta(seconds=chosen.randrange(seconds)), k, sizes(chosen)) for k in range(n)]


@pytest.mark.parametrize(
    "rows, limit, block_entries",
    [
        (entries(3000, lambda r: r.randrange(1, 40), 5 * 86400), 200, 64),
        (entries(3000, lambda r: 7, 2 * 86400), 50, 16),
        (entries(2000, lambda r: r.choice([1, 2, 3, 500, None, -4]), 3600), 100, 32),
        (entries(2000, lambda r: r.randrange(1, 9), 3600), 4000, 8),
        (entries(500, lambda r: r.randrange(1, 9), 86400), 10**12, 1 << 18),
        (entries(500, lambda r: r.randrange(0, 9), 86400) + [(None, k, 30) for k in range(600, 620)], 1, 4),
        (entries(400, lambda r: 5, 2), 64, 1 << 18),
    ],
)
def test_segments_are_those_of_a_walk(spark, rows, limit, block_entries):
    assert segments(spark, rows, limit, "minute", block_entries=block_entries) == walked(rows, limit)


def test_no_entries_no_segments(spark):
    assert segments(spark, [], 100) == []


def test_a_segment_has_a_byte(spark):
    with pytest.raises(ValueError):
        segments(spark, [], 0)


@pytest.mark.parametrize("seed", range(20))
def test_jump_tables_follow_the_cuts(seed):
    chosen = random.Random(seed)
    start, limit = chosen.randrange(1000), chosen.randrange(1, 60)
    places = np.unique([start + chosen.randrange(400) for _ in range(chosen.randrange(1, 120))])
    upto, due = jump_table(places, limit, start)
    for t in range(max(0, start - 3), start + limit):
        at = t
        while (later := places[places >= at]).size:
            at = later[0] + limit
        hit = np.searchsorted(upto, t)
        assert (due[hit] if hit < len(due) else t) == at
