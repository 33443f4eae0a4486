"""Order-dependent operators that never sort a whole table, or a whole hot key, in one task.

The caller names a *slice*: a column expression that grows with the sort order, such as the hour of a
timestamp or a range of ids. Rows are numbered inside each slice, and one small row per slice carries the
running state to the next slice. The slice is a pure function of the row, so a recomputed task gives the
same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "__key"
LOCAL = "__local"


def id_slice(column: str, width: int = 1 << 17) -> Column:
    """A slice of ``width`` consecutive ids."""
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def observed_slice(df: DataFrame, column: str, rows: int = 1 << 20, most: int = 4096) -> Column:
    """Slices of about ``rows`` rows each, however the values of a numeric or time column lie; at most ``most`` slices,
    which then grow with the table. Equal values share a slice, nulls have slice -1.

    The bounds are quantiles of the column from one job over it, run now, and are constants of the plan: a recomputed
    task finds the same slice. Not more than ``most`` numbers come to the driver.
    """
    column_type = df.schema[column].dataType.simpleString()
    fine = F.percentile_approx(column, [k / most for k in range(1, most)], 16 * most)
    seen = df.agg(F.count(column).alias("n"), F.transform(fine, lambda b: b.cast("string")).alias("bounds")).first()
    slices = min(most, -(-seen["n"] // rows)) or 1
    bounds = list(dict.fromkeys(seen["bounds"][k * most // slices - 1] for k in range(1, slices))) if seen["n"] else []
    if not bounds:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    places = F.split(F.lit("|".join(bounds)), r"\|").cast(f"array<{column_type}>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    after = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(places, at + step - 1) < F.col(column), step).otherwise(0))
    return F.when(F.col(column).isNull(), -1).otherwise(after)


def time_slice(column: str, unit: str = "hour") -> Column:
    """A slice of one calendar unit."""
    return F.date_trunc(unit, F.col(column))


def sliced(df: DataFrame, keys: Sequence[str], slice_by: Column) -> DataFrame:
    """Add the struct of keys and slice. A struct is never null itself, so rows with null keys join too, and
    the window and the join that follows share one shuffle."""
    return df.withColumn(KEY, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], slice_by.alias("slice")))


def within(order_by: Sequence[Column]):
    return Window.partitionBy(KEY).orderBy(*order_by)


def across(keys: Sequence[str], descending: bool = False):
    at = F.col(f"{KEY}.slice")
    owners = [F.col(f"{KEY}.k{i}") for i, _ in enumerate(keys)]
    return Window.partitionBy(*owners).orderBy(at.desc() if descending else at.asc())


def carried_sum(sums: DataFrame, value: Column, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """Sum of ``value`` over the slices before each slice."""
    before = across(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(KEY, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("__before"))


def numbered(
    df: DataFrame,
    order_by: Sequence[Column],
    slice_by: Column,
    keys: Sequence[str] = (),
    out: str = "position",
    descending: bool = False,
) -> DataFrame:
    """1-based position of each row in ``order_by``, within ``keys`` or over the whole table."""
    rows_in = sliced(df, keys, slice_by)
    sizes = rows_in.groupBy(KEY).agg(F.count(F.lit(1)).alias("__size"))
    offsets = carried_sum(sizes, F.col("__size"), keys, descending)
    rows = rows_in.withColumn(LOCAL, F.row_number().over(within(order_by)))
    position = (F.col(LOCAL) + F.col("__before")).cast("bigint")
    return rows.join(offsets, KEY).withColumn(out, position).drop(KEY, LOCAL, "__before")


def with_previous(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    slice_by: Column,
    keys: Sequence[str],
    out: str = "previous",
    position: str | None = None,
) -> DataFrame:
    """The value of the row before, per key: ``lag`` for keys of any size.

    ``position`` names a column for the place of the row, which the same pass can tell.
    """
    rows_in = sliced(df, keys, slice_by)
    window = within([F.col(c) for c in order_by])
    rows = rows_in.withColumns(
        {LOCAL: F.row_number().over(window), "__lag": F.lag(value).over(window)}
    )
    ends = rows_in.groupBy(KEY).agg(
        F.max(F.struct(*order_by, F.col(value).alias("__value"))).alias("__last"), F.count(F.lit(1)).alias("__size")
    )
    along = across(keys)
    before = F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(
        KEY, F.lag("__last.__value").over(along).alias("__carried"), F.coalesce(before, F.lit(0)).alias("__before")
    )
    columns = {out: F.when(F.col(LOCAL) == 1, F.col("__carried")).otherwise(F.col("__lag"))}
    if position:
        columns[position] = (F.col(LOCAL) + F.col("__before")).cast("bigint")
    return rows.join(carried, KEY).withColumns(columns).drop(KEY, LOCAL, "__lag", "__carried", "__before")


def running_total(
    df: DataFrame,
    value: str,
    order_by: Sequence[Column],
    slice_by: Column,
    keys: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """Sum of ``value`` up to and including each row, per key."""
    rows_in = sliced(df, keys, slice_by)
    sums = rows_in.groupBy(KEY).agg(F.sum(value).alias("__sum"))
    offsets = carried_sum(sums, F.col("__sum"), keys)
    so_far = within(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows_in.withColumn(LOCAL, F.sum(value).over(so_far))
    total = F.col(LOCAL) + F.col("__before")
    return rows.join(offsets, KEY).withColumn(out, total).drop(KEY, LOCAL, "__before")


def keep_newest(
    df: DataFrame,
    count: int,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    slice_by: Column | None = None,
) -> DataFrame:
    """Bounded retention: the first ``count`` rows of ``order_by`` (newest first), overall or per key.

    Without keys every task passes on at most ``count`` rows. With keys the sizes of the slices tell which
    slices can hold kept rows; only those are sorted, so a hot key costs no more than what is kept.
    """
    if not keys:
        return df.orderBy(*order_by).limit(count)
    if slice_by is None:
        raise ValueError("retention per key needs a slice of the order")
    rows_in = sliced(df, keys, slice_by)
    sizes = rows_in.groupBy(KEY).agg(F.count(F.lit(1)).alias("__size"))
    needed = carried_sum(sizes, F.col("__size"), keys, descending=True).where(F.col("__before") < count)
    ranked = rows_in.join(needed, KEY).withColumn(LOCAL, F.row_number().over(within(order_by)))
    return ranked.where(F.col(LOCAL) + F.col("__before") <= count).drop(KEY, LOCAL, "__before")


def latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row per key, found by a partially aggregated ``max_by`` instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*")


def page(df: DataFrame, order_by: Sequence[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of a listing; out-of-range paging arguments leave the listing whole."""
    ordered = df.orderBy(*order_by)
    if offset < 0 or limit <= 0:
        return ordered
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
