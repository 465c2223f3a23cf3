"""Daily series: totals per day, lags, rolling statistics, aligned years, price-level counts.

The heavy step is the sum per day, a map-side combined aggregate. Every window runs on the
aggregated days, at most one row per series and calendar day.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.dates import (
    SPRING_FESTIVAL,
    add_distance_parts,
    same_day_years_back,
)
from cohortcast.session import stage

# Outlier thresholds, lag offsets and window length of the forecast features.
MAX_RATIO, MIN_RATIO = 1.9, 0.7
LAG_OFFSETS = (0, 1, 2, 3, 6)
WEEK = 7


def _by_day(keys: Sequence[str], day: str = "dt") -> Window:
    return Window.partitionBy(*keys).orderBy(day)


def _by_number(keys: Sequence[str], day: str = "dt") -> Window:
    """Days as numbers, for frames of calendar days."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(day))


def daily_sum(df: DataFrame, day: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dt, label): the sum per day; the day may be text."""
    per_day = df.groupBy(*keys, F.col(day).alias("day_")).agg(F.sum(value).alias("label"))
    return per_day.select(*keys, F.col("day_").cast("date").alias("dt"), "label")


def _own_day(daily: DataFrame, days: Column, keys: Sequence[str]) -> DataFrame:
    """Turn every row into one row per listed day; only its own day keeps the other columns."""
    others = [c for c in daily.columns if c not in (*keys, "dt")]
    rows = daily.withColumn("_day", F.explode(days))
    own = F.col("_day") == F.col("dt")
    return rows.select(
        *keys, F.col("_day").alias("dt"), *[F.when(own, F.col(c)).alias(c) for c in others]
    )


def fill_days(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the missing days between a series' first and last day, with a NULL label.

    Every row fills the gap up to the next one, so the series needs no join with a calendar.
    """
    following = F.lead("dt").over(_by_day(keys))
    rows = daily.withColumn("_last", F.coalesce(F.date_sub(following, 1), F.col("dt")))
    return _own_day(rows, F.sequence("dt", "_last"), keys).drop("_last")


def add_future_days(daily: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Append the n days after a series' last day, with a NULL label; the last row makes them."""
    following = F.lead("dt").over(_by_day(keys))
    rows = daily.withColumn("_last", F.when(following.isNull(), F.date_add("dt", n)).otherwise(F.col("dt")))
    return _own_day(rows, F.sequence("dt", "_last"), keys).drop("_last")


def smooth_outliers(
    daily: DataFrame,
    keys: Sequence[str] = (),
    max_ratio: float = MAX_RATIO,
    min_ratio: float = MIN_RATIO,
    step: int = WEEK,
) -> DataFrame:
    """Add ``label_smooth``: the mean of the same weekday before and after where the label strays.

    NULL where a neighbour is missing or label and mean are both 0.
    """
    w = _by_day(keys)
    mean = (F.lag("label", step).over(w) + F.lead("label", step).over(w)) / F.lit(2.0)
    rows = daily.withColumn("_mean", mean)
    ratio = F.try_divide("label", "_mean")
    strays = (ratio >= max_ratio) | (ratio <= min_ratio)
    smooth = F.when(F.col("_mean") == 0, F.when(F.col("label") != 0, F.col("_mean"))).when(
        strays, F.col("_mean")
    )
    smooth = smooth.when(ratio.isNotNull(), F.col("label"))
    return rows.withColumn("label_smooth", smooth).drop("_mean")


def _trailing(window: Window, days: int, n: int) -> Window:
    """Frame of the ``days + n`` calendar days that end n days before."""
    return window.rangeBetween(-(2 * n + days - 1), -n)


def add_trailing_sum(
    daily: DataFrame, days: int, n: int, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Add the sum over the ``days + n`` calendar days that end n days before; missing days are 0."""
    total = F.sum("label").over(_trailing(_by_number(keys), days, n))
    return daily.withColumn(name, F.coalesce(total, F.lit(0.0)))


def add_aligned(
    rows: DataFrame,
    years: int,
    label: str | None = None,
    trailing: str | None = None,
    days: int = WEEK,
    n: int = 0,
    keys: Sequence[str] = (),
    calendar: Mapping[int, dt.date] = SPRING_FESTIVAL,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add values as of the comparable day ``years`` earlier: its label and its trailing sum.

    The comparable day need not be in the series. Rows are placed at that day among the days of
    ``source`` (default: the rows' own days) and read the frame around it, which takes one shuffle
    by series instead of a join per value.
    """
    source = rows if source is None else source
    asked = rows.select(
        *keys, same_day_years_back("dt", years, calendar).alias("_at"), F.struct("*").alias("_row")
    )
    known = source.select(*keys, F.col("dt").alias("_at"), F.col("label").alias("_label"))
    w = _by_number(keys, "_at")
    exists = F.col("_at").isNotNull()
    values = {}
    if label:
        values[label] = F.when(exists, F.max("_label").over(w.rangeBetween(0, 0)))
    if trailing:
        total = F.sum("_label").over(_trailing(w, days, n))
        values[trailing] = F.when(exists, F.coalesce(total, F.lit(0.0)))
    placed = known.unionByName(asked, allowMissingColumns=True).withColumns(values)
    return placed.filter(F.col("_row").isNotNull()).select("_row.*", *values)


def add_rolling_stats(
    daily: DataFrame, n: int, keys: Sequence[str] = (), days: int = WEEK
) -> DataFrame:
    """Add min, max, mean, sample deviation and median of the ``days`` rows that end n rows before."""
    w = _by_day(keys).rowsBetween(-(days - 1) - n, -n)
    return daily.withColumns(
        {
            "stat_min": F.min("label").over(w),
            "stat_max": F.max("label").over(w),
            "stat_mean": F.avg("label").over(w),
            "stat_std": F.stddev_samp("label").over(w),
            "stat_median": F.percentile("label", 0.5).over(w),
        }
    )


def add_lags(daily: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Add lags, differences and ratios of neighbouring lags from n rows back."""
    w = _by_day(keys)
    rows = daily.withColumns({f"sale_lag_{n + o}": F.lag("label", n + o).over(w) for o in LAG_OFFSETS})
    extra = {}
    for i in range(n, n + 3):
        older, newer = F.col(f"sale_lag_{i + 1}"), F.col(f"sale_lag_{i}")
        extra[f"sale_fod_{i}"] = older - newer
        extra[f"sale_huanbi_{i}"] = F.try_divide(older, newer)
    return rows.withColumns(extra)


def daily_features(
    sales: DataFrame,
    n: int,
    day: str = "ancestor_order_create_dt",
    value: str = "pay_gmv_d1",
    keys: Sequence[str] = (),
    calendar: Mapping[int, dt.date] = SPRING_FESTIVAL,
    densify: bool = False,
) -> DataFrame:
    """The forecast features for a horizon of n days, from raw sales rows.

    The raw rows are read once; the features read the written daily totals.
    """
    daily = stage(daily_sum(sales, day, value, keys), "daily")
    return features_from_daily(daily, n, keys, calendar, densify)


def features_from_daily(
    daily: DataFrame,
    n: int,
    keys: Sequence[str] = (),
    calendar: Mapping[int, dt.date] = SPRING_FESTIVAL,
    densify: bool = False,
) -> DataFrame:
    """The forecast features from daily totals.

    Lags and rolling windows count rows; ``densify`` adds the missing days first so that they
    count calendar days.
    """
    if densify:
        daily = fill_days(daily, keys)
    rows = add_future_days(daily, n, keys)
    rows = smooth_outliers(rows, keys)
    rows = add_rolling_stats(rows, n, keys)
    rows = add_lags(rows, n, keys)
    rows = add_trailing_sum(rows, WEEK, n, "label_7d_mean", keys)
    rows = add_aligned(
        rows, 1, "last_1_year_label", "last_1_year_label_7d_mean", WEEK, n, keys, calendar, daily
    )
    rows = add_aligned(rows, 2, "last_2_year_label", None, WEEK, n, keys, calendar, daily)
    rows = add_growth(rows)
    rows = add_distance_parts(rows, "dt", calendar)
    return rows.withColumns(
        {
            "weekday": F.weekday("dt"),
            "month_int": F.month("dt"),
            "quarter_int": F.quarter("dt"),
        }
    ).select(*keys, "dt", "label", *_feature_order(n))


def add_growth(rows: DataFrame) -> DataFrame:
    """Add the two-year sum, the growth of the trailing sum and the growth-adjusted old label."""
    growth = F.try_divide("label_7d_mean", "last_1_year_label_7d_mean")
    return rows.withColumns(
        {
            "last_2_year_mean_label": F.col("last_2_year_label") + F.col("last_1_year_label"),
            "label_7d_mean_uplift": growth,
            "last_1_year_label_fix": F.col("last_1_year_label") * growth,
        }
    )


def _feature_order(n: int) -> list[str]:
    names = [
        "weekday", "label_smooth", "last_1_year_label", "last_2_year_label",
        "last_2_year_mean_label", "last_1_year_label_7d_mean", "label_7d_mean",
        "label_7d_mean_uplift", "last_1_year_label_fix", "quarter_int", "is_weekend_bool",
        "day_to_spring_int", "day_to_0501_int", "day_to_0618_int", "day_to_1001_int",
        "day_to_1111_int", "month_int", "stat_min", "stat_max", "stat_mean", "stat_std",
        "stat_median",
    ]
    names += [f"sale_lag_{n + o}" for o in LAG_OFFSETS]
    names += [f"sale_fod_{i}" for i in range(n, n + 3)]
    return names + [f"sale_huanbi_{i}" for i in range(n, n + 3)]


# ---- price levels ------------------------------------------------------------------------------


def price_level_counts(
    prices: DataFrame,
    levels: Sequence[str],
    brands: Sequence[str] = (),
    day: str = "plan_date",
    level: str = "price_level",
    brand: str = "dim_prd_brand",
    item: str = "pid",
) -> DataFrame:
    """Items per day and level, and per day, brand and level, as columns ``level``, ``brand_level``.

    Rows are first counted per (day, brand, level); only those counts are spread over columns. The
    value lists are given, so that the schema does not depend on the data. NULL where no row is.
    """
    keys = [day, brand, level] if brands else [day, level]
    counts = prices.groupBy(*keys).agg(F.count(item).alias("n"))
    names = [F.col(level)] + ([F.concat_ws("_", brand, level)] if brands else [])
    values = [*levels, *[f"{b}_{v}" for b in brands for v in levels]]
    named = counts.select(F.col(day).alias("day_"), "n", F.explode(F.array(*names)).alias("name"))
    wide = named.groupBy("day_").pivot("name", values).agg(F.sum("n"))
    return wide.select(F.col("day_").cast("date").alias("dt"), *[f"`{v}`" for v in values])


def level_pivot(
    prices: DataFrame, levels: Sequence[str], day: str = "plan_date", level: str = "price_level",
    item: str = "pid",
) -> DataFrame:
    """Items per day, one column per level."""
    wide = prices.groupBy(day).pivot(level, list(levels)).agg(F.count(item))
    return wide.withColumn(day, F.col(day).cast("date")).withColumnRenamed(day, "dt")


def brand_level_pivot(
    prices: DataFrame, levels: Sequence[str], brands: Sequence[str], day: str = "plan_date",
    level: str = "price_level", brand: str = "dim_prd_brand", item: str = "pid",
) -> DataFrame:
    """Items per day, one column per brand and level."""
    values = [f"{b}_{v}" for b in brands for v in levels]
    both = prices.withColumn("_bl", F.concat_ws("_", brand, level))
    wide = both.groupBy(day).pivot("_bl", values).agg(F.count(item))
    return wide.withColumn(day, F.col(day).cast("date")).withColumnRenamed(day, "dt")


def bind_days(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two day tables side by side; days of either are kept."""
    return left.join(right, "dt", "full_outer")


def clean_names(df: DataFrame) -> DataFrame:
    """Brackets, commas, slashes, quotes and white space in column names become ``_``."""
    names = [re.sub("[()（）,，/'\"\\s]", "_", c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names clash after cleaning: {clashes}")
    return df.toDF(*names)


def priced_features(
    sales: DataFrame,
    prices: DataFrame,
    n: int,
    levels: Sequence[str],
    brands: Sequence[str] = (),
    keys: Sequence[str] = (),
    calendar: Mapping[int, dt.date] = SPRING_FESTIVAL,
) -> DataFrame:
    """The forecast features with the day's price-level counts, names cleaned."""
    features = daily_features(sales, n, keys=keys, calendar=calendar)
    counts = price_level_counts(prices, levels, brands)
    return clean_names(features.join(counts, "dt", "left"))


def add_future_labels(
    df: DataFrame,
    length: int,
    target: str = "label",
    day: str = "dt",
    mark: str = "label_",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the target 1..length rows ahead as ``{mark}{i}_real``."""
    w = _by_day(keys, day)
    return df.withColumns(
        {f"{mark}{i}_real": F.lead(target, i).over(w) for i in range(1, length + 1)}
    )


def feature_and_label_columns(
    df: DataFrame, target: str, mark: str, unused: Sequence[str] = ()
) -> tuple[list[str], list[str]]:
    """(feature columns, label columns) by name: labels start with ``mark``."""
    labels = [c for c in df.columns if c.startswith(mark)]
    features = [c for c in df.columns if c != target and c not in labels and c not in unused]
    return features, labels
