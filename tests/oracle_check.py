"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf_dir] [name-substring ...]``."""

from __future__ import annotations

import datetime
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pyarrow as pa  # noqa: E402

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def type_name(kind: pa.DataType) -> str:
    if pa.types.is_timestamp(kind):
        return "timestamp"
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return "string"
    return str(kind)


def canonical(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if value is None or isinstance(value, (int, str, bytes, bool)) else repr(value)


def rows_of(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    columns = [[canonical(v) for v in table.column(name).to_pylist()] for name in names]
    return Counter(zip(*columns)) if columns else Counter()


def compare(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    problems = []
    left = {f.name: type_name(f.type) for f in spark_table.schema}
    right = {f.name: type_name(f.type) for f in sql_table.schema}
    if left != right:
        problems.append(f"schema: spark={left} sql={right}")
        if set(left) != set(right):
            return problems
    if spark_table.num_rows != sql_table.num_rows:
        problems.append(f"rows: spark={spark_table.num_rows} sql={sql_table.num_rows}")
    a, b = rows_of(spark_table), rows_of(sql_table)
    if a != b:
        problems.append(f"columns {sorted(left)}")
        problems.append(f"only spark ({sum((a - b).values())}): {list((a - b))[:3]}")
        problems.append(f"only sql ({sum((b - a).values())}): {list((b - a))[:3]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from millrace.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session("oracle-check")
    connection = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = fn(spark, sf_dir).toArrow()
            took = time.time() - start
            if name in oracles:
                problems = compare(result, connection.sql(oracles[name]).to_arrow_table())
                verdict = "ok" if not problems else "MISMATCH"
            else:
                problems, verdict = [], "rows-only"
            print(f"{verdict:10} {name:28} rows={result.num_rows:7d} {took:6.2f}s", flush=True)
        except Exception as error:  # report and go on with the other queries
            problems = [str(error)[:1500]]
            print(f"{'ERROR':10} {name}", flush=True)
        bad += bool(problems)
        for problem in problems:
            print("    ", problem[:1200], flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
