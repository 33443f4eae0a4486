"""Record transforms: computed fields, renames, casts, flattening, merges and defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Type tags that ports may carry; any other tag reads as "any".
PORT_TAGS = ("any", "string", "integer", "float", "boolean", "array", "object", "file", "binary")


def compute(df: DataFrame, **expressions: str) -> DataFrame:
    """Add fields from SQL expressions."""
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def rename(df: DataFrame, spec: str) -> DataFrame:
    """Rename fields as told by text such as ``a -> b, c -> d``."""
    moves = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        old, arrow, new = (p.strip() for p in part.partition("->"))
        if not arrow or not old or not new:
            raise ValueError(f"not a rename: {part!r}")
        if old not in df.columns:
            raise ValueError(f"no such field: {old!r}")
        moves[old] = new
    return df.withColumnsRenamed(moves)


def convert(df: DataFrame, **types: str) -> DataFrame:
    """Cast fields; a value that does not fit becomes null."""
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in types.items()})


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Turn struct fields into columns, at any depth, and arrays of records into rows."""
    while True:
        lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
        if lists:
            df = df.withColumn(lists[0], F.explode_outer(lists[0]))
            continue
        nested = [f for f in df.schema if isinstance(f.dataType, StructType)]
        if not nested:
            return df
        plain = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, StructType)]
        inner = [
            F.col(f.name)[child.name].alias(f"{f.name}{separator}{child.name}") for f in nested for child in f.dataType
        ]
        df = df.select(*plain, *inner)


def with_defaults(df: DataFrame, inputs: Mapping[str, tuple[bool, object]]) -> DataFrame:
    """Fill in defaults and list required inputs that stay empty in ``missing_inputs``.

    ``inputs`` maps a column to (required, default); a default of None means there is none.
    """
    filled = df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(default)) for name, (_, default) in inputs.items() if default is not None}
    )
    required = [name for name, (needed, default) in inputs.items() if needed and default is None]
    if not required:
        return filled.withColumn("missing_inputs", F.lit(""))
    absent = [F.when(F.col(name).isNull(), F.lit(name)) for name in required]
    return filled.withColumn("missing_inputs", F.concat_ws(",", *absent))


def port_tag(tag: Column) -> Column:
    lowered = F.lower(tag)
    return F.when(lowered.isin(*PORT_TAGS), lowered).otherwise("any")


def compatible(source: Column, target: Column) -> Column:
    """``any`` goes with everything, other tags only with themselves."""
    a, b = port_tag(source), port_tag(target)
    return (a == "any") | (b == "any") | (a == b)


def append_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns that one side lacks become null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def distinct_first(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """One row per key, the one with the smallest ``row_id``, which must be unique.

    Only keys and ids are grouped, so wide rows are not carried through the aggregation; give a digest as
    the key of long texts. Copies are counted away before the shuffle.
    """
    first = df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(first, row_id, "left_semi")
