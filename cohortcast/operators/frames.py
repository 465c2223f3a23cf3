"""Cleaning, joins, unions and picks on whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_means(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL by the column's mean; one pass for all means, one row to the driver."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [c for c, t in df.dtypes if (t in numeric if columns is None else c in columns)]
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
    fills = {
        c: F.coalesce(F.col(c), F.lit(m)) for c, m in means.items() if m is not None
    }
    return df.withColumns(fills)


def as_text(df: DataFrame, empty: str = "") -> DataFrame:
    """Every column as text, NULL as the empty text."""
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(empty)).alias(c) for c in df.columns]
    )


def look_up(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str
) -> DataFrame:
    """Add the value found under a key in another table, NULL where the key is absent.

    Spark broadcasts the table only if its size allows; the last entry wins is not needed, since a
    repeated key is reduced to its largest value.
    """
    entries = table.groupBy(F.col(table_key).alias(key)).agg(F.max(value).alias(name))
    return df.join(entries, key, "left")


def unite(tables: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union all by column name."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=allow_missing)
    return out


def one_row(tables: Sequence[DataFrame]) -> DataFrame:
    """The columns of several one-row tables in one row."""
    rows = unite(tables, allow_missing=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def unite_ids(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct values of a column over several tables."""
    return unite([t.select(column) for t in tables]).distinct()


def near_days(df: DataFrame, day: str, days: Mapping[int, object], window: int = 21) -> DataFrame:
    """Rows with each listed day within ``window`` days, as ``near_day``; the list is short."""
    listed = F.array(*[F.lit(d) for d in days.values()])
    close = F.filter(listed, lambda d: F.abs(F.datediff(d, F.col(day))) <= window)
    return df.withColumn("near_day", F.explode(close))


def keep_first(
    df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """First row per combination of the subset columns, in the given order.

    Spark limits each combination to one row per task before the shuffle, so that a frequent
    combination does not gather in one task.
    """
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_rows(
    df: DataFrame, n: int, order: Sequence[Column], groups: Sequence[str] = ()
) -> DataFrame:
    """The first n rows in an order, overall or per group. For reports: n is small."""
    if not groups:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def nearest_entry(df: DataFrame, key: str, distance: str) -> DataFrame:
    """Smallest distance per key, combined before the shuffle."""
    return df.groupBy(key).agg(F.min(distance).alias(distance))
