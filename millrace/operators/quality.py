"""Data-quality scores, computed in one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from millrace.operators.validation import issue

# The default thresholds.
MIN_COMPLETENESS = 0.8
MIN_ACCURACY = 0.9
MAX_NULL_PERCENT = 0.1


def row_accurate(df: DataFrame, columns: Sequence[str]) -> Column:
    """No empty string and no NaN or infinity in the row; nulls are not looked at."""
    bad = [F.lit(False)]
    for field in df.select(*columns).schema:
        c = F.col(field.name)
        if isinstance(field.dataType, StringType):
            bad.append(F.coalesce(c == "", F.lit(False)))
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            infinite = c.isin(float("inf"), float("-inf"))
            bad.append(F.coalesce(F.isnan(c) | infinite, F.lit(False)))
    return ~reduce(lambda a, b: a | b, bad)


def profile_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add what a row brings to the scores: ``cells_filled`` and ``row_ok``.

    Profile the sides of a join before joining them: then only these two narrow columns are shuffled.
    """
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return df.withColumns({"cells_filled": filled, "row_ok": row_accurate(df, columns)})


def score_rows(profiled: DataFrame, width: int, group: Sequence[str] = ()) -> DataFrame:
    """Completeness, accuracy and null percent of profiled rows of ``width`` cells, overall or per group."""
    totals = profiled.groupBy(*group).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.sum("cells_filled"), F.lit(0)).alias("__filled"),
        F.count_if("row_ok").alias("__accurate"),
    )
    cells = F.col("record_count") * width
    return totals.select(
        *group,
        "record_count",
        F.try_divide(F.col("__filled"), cells).alias("completeness"),
        F.try_divide(F.col("__accurate"), F.col("record_count")).alias("accuracy"),
        F.try_divide(cells - F.col("__filled"), cells).alias("null_percent"),
    )


def scores(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Completeness, accuracy and null percent, over the whole table or per group."""
    return score_rows(profile_rows(df, columns), len(columns), group)


def judged_while(df: DataFrame, columns: Sequence[str], write: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``write`` on ``df`` and give the verdict on the rows it wrote, counted on the way: one scan for both.

    Observed metrics count what passes the last stage, so ``write`` should do no more than write. See ``verdict``.
    """
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    seen = Observation()
    write(
        df.observe(
            seen,
            F.count(F.lit(1)).alias("record_count"),
            F.coalesce(F.sum(filled), F.lit(0)).cast("long").alias("filled"),
            F.count_if(row_accurate(df, columns)).alias("accurate"),
        )
    )
    totals = seen.get
    one = df.sparkSession.createDataFrame([tuple(totals[c] for c in ("record_count", "filled", "accurate"))], "record_count long, filled long, accurate long")
    cells = F.col("record_count") * len(columns)
    return verdict(
        one.select(
            "record_count",
            F.try_divide("filled", cells).alias("completeness"),
            F.try_divide("accurate", "record_count").alias("accuracy"),
            F.try_divide(cells - F.col("filled"), cells).alias("null_percent"),
        )
    )


def verdict(
    scored: DataFrame,
    min_completeness: float = MIN_COMPLETENESS,
    min_accuracy: float = MIN_ACCURACY,
    max_null_percent: float = MAX_NULL_PERCENT,
) -> DataFrame:
    """Errors and warnings of scored groups; valid when there are no errors. No rows at all is an error."""

    def below(name: str, threshold: float, words: str) -> Column:
        return F.format_string(f"{name.replace('_', ' ')} %.2f {words} threshold {threshold:.2f}", F.col(name))

    errors = F.array(
        F.when(F.col("record_count") == 0, issue("data", F.lit("data is empty"))),
        F.when(
            F.col("completeness") < min_completeness,
            issue("completeness", below("completeness", min_completeness, "is below")),
        ),
        F.when(F.col("accuracy") < min_accuracy, issue("accuracy", below("accuracy", min_accuracy, "is below"))),
    )
    warnings = F.array(
        F.when(
            F.col("null_percent") > max_null_percent,
            issue("null_percent", below("null_percent", max_null_percent, "exceeds")),
        )
    )
    return scored.withColumns(
        {
            "errors": F.filter(errors, lambda e: e.isNotNull()),
            "warnings": F.filter(warnings, lambda e: e.isNotNull()),
        }
    ).withColumn("valid", F.size("errors") == 0)


def row_errors(cells_filled: Column, row_ok: Column, width: int) -> Column:
    """Quality errors of a single profiled record, seen as a data set of one row."""
    errors = F.array(
        F.when(cells_filled / F.lit(width) < MIN_COMPLETENESS, issue("completeness", F.lit("record is incomplete"))),
        F.when(~row_ok, issue("accuracy", F.lit("record holds an empty or broken value"))),
    )
    return F.filter(errors, lambda e: e.isNotNull())


def duplicates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Values of the unique fields that occur more than once, with their count."""
    return df.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
