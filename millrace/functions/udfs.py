"""User functions in Python: per record batch, per scanned value and with setup per task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a scan that a task holds at a time.
SCAN_ROWS = 10_000


def record_function(
    df: DataFrame,
    execute: Callable[..., pd.DataFrame],
    schema: str,
    setup: Callable[[], object] | None = None,
    teardown: Callable[[object], None] | None = None,
) -> DataFrame:
    """Apply ``execute`` to Arrow batches of records.

    With ``setup`` its result is made once per task and passed as second argument; ``teardown`` gets it back
    when the task ends, even when it fails.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        try:
            for batch in batches:
                yield execute(batch, state) if setup else execute(batch)
        finally:
            if teardown:
                teardown(state)

    return df.mapInPandas(run, schema)


def scan_function(
    df: DataFrame, key: str, value: str, scan: Callable[[object], Iterable[tuple]], schema: str
) -> DataFrame:
    """Table function: every value gives any number of rows ``schema``, returned with the key.

    Rows leave in pieces of ``SCAN_ROWS``, so a value may give more rows than fit in memory.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((k, *row) for k, v in zip(batch[key], batch[value]) for row in scan(v))
            while piece := list(islice(rows, SCAN_ROWS)):
                yield pd.DataFrame(piece, columns=[key, *names])

    return df.select(key, value).mapInPandas(run, f"{key} {kind}, {schema}")
