"""Where queries and their SQL twins are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with SQL giving the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Put the stand-in views that ``sql`` mentions in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view, body in SQL_VIEWS.items():
            if view not in needed and re.search(rf"(?:from|join)\s+{view}\b", text, re.IGNORECASE):
                visit(body)
                if view not in needed:
                    needed.append(view)

    visit(sql)
    head = re.match(r"\s*with\s+(recursive\s+)?", sql, re.IGNORECASE)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{view} AS ({SQL_VIEWS[view]})" for view in needed)
    if head is None:
        return f"WITH {ctes}\n{sql.strip()}"
    recursive = "RECURSIVE " if head.group(1) else ""
    return f"WITH {recursive}{ctes},\n{sql[head.end():].strip()}"
