"""Data checks that return the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_days(df: DataFrame, day: str = "dt", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, n) for days that occur more than once in a series."""
    return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_days(df: DataFrame, day: str = "dt", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day) for days a series lacks between its first and last day."""
    # at most one row per series and calendar day
    days = df.select(*keys, F.col(day).cast("date").alias("dt")).distinct()
    following = F.lead("dt").over(Window.partitionBy(*keys).orderBy("dt"))
    gaps = days.withColumn("next", following).filter(F.datediff("next", "dt") > 1)
    lost = F.sequence(F.date_add("dt", 1), F.date_sub("next", 1))
    return gaps.select(*keys, F.explode(lost).alias(day))


def day_coverage(df: DataFrame, day: str = "dt", keys: Sequence[str] = ()) -> DataFrame:
    """Per series: rows, distinct days, days in its span, and whether every day occurs once."""
    # counted per day first, so that a busy day or series is combined before it moves
    per_day = df.groupBy(*keys, F.col(day).cast("date").alias("dt")).agg(
        F.count(F.lit(1)).alias("n")
    )
    span = F.datediff(F.max("dt"), F.min("dt")) + 1
    return per_day.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_days"),
        span.cast("long").alias("n_span"),
        ((F.sum("n") == F.count(F.lit(1))) & (F.count(F.lit(1)) == span)).cast("int").alias("complete"),
    )


def require_daily(
    df: DataFrame, day: str = "dt", drop: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Drop columns, fail on a repeated or missing day, turn the day into a date and number rows.

    The input is a daily table, so a series' rows are bounded by its calendar days.
    """
    if duplicate_days(df, day, keys).limit(1).count():
        raise ValueError("a day occurs twice")
    if missing_days(df, day, keys).limit(1).count():
        raise ValueError("a day is missing")
    return number_rows(df.drop(*drop).withColumn(day, F.col(day).cast("date")), day, keys)


def number_rows(
    df: DataFrame, day: str = "dt", keys: Sequence[str] = (), name: str = "time_idx"
) -> DataFrame:
    """Row number from 0 by day within a series."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumn(name, F.row_number().over(w) - 1)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail unless the named columns exist."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) in one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns]
    )
    return counts.select(F.inline(pairs))


def value_span(df: DataFrame, column: str) -> DataFrame:
    """One row with the smallest and largest value and the number of distinct values.

    Values are combined per task first, so that a frequent value costs no more than a rare one.
    """
    values = df.select(column).distinct()
    return values.agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n_distinct")
    )
