"""Queries over daily sales: features, calendars, splits and checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.fixtures import (
    CALENDAR,
    CALENDAR_SQL,
    DAILY_SQL,
    LEVELS,
    PRICE_SQL,
    gmv,
    price_level,
    r,
    table,
)
from catalog.registry import day, query, rnd
from cohortcast.functions import dates
from cohortcast.operators import checks, frames, series, splits
from cohortcast.session import stage

# The brands of the part table.
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
N = 3


def daily(spark, sf_dir):
    """Daily totals, written once: the features read them several times."""
    per_day = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    return stage(per_day, "daily")


def nation_sales(spark, sf_dir):
    """Sales with the buyer's nation, for one series per nation."""
    buyers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("dt"), "o_totalprice"
    )
    return orders.join(buyers, "o_custkey")


NATION_SQL = """
nation_daily AS (
  SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS dt, SUM(o_totalprice) AS label
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""

FUTURE_SQL = (
    DAILY_SQL
    + f""",
spine AS (
  SELECT dt, label FROM daily
  UNION ALL
  SELECT CAST((SELECT MAX(dt) FROM daily) + CAST(i AS INT) AS DATE), NULL
  FROM range(1, {N + 1}) t(i))"""
)


def aligned_sql(source: str, years: int, name: str) -> str:
    """SQL for the comparable day of an earlier year."""
    return f"""{name} AS (
  SELECT s.dt, CASE WHEN c.year IS NULL THEN CAST(s.dt - INTERVAL {years} YEAR AS DATE)
                    ELSE CAST(p.fest - CAST(c.fest - s.dt AS INT) AS DATE) END AS day
  FROM {source} s LEFT JOIN cal c ON ABS(c.fest - s.dt) <= 21
  LEFT JOIN cal p ON p.year = c.year - {years})"""


def trailing_sql(day_sql: str) -> str:
    """SQL for the trailing sum as of a day, over the daily table."""
    return (
        f"COALESCE((SELECT SUM(label) FROM daily d WHERE d.dt BETWEEN "
        f"{day_sql} - {2 * N + 6} AND {day_sql} - {N}), 0)"
    )


@query(
    "daily_sum",
    f"WITH {DAILY_SQL} SELECT CAST(dt AS VARCHAR) AS dt, {r('label', 2, 'label')} FROM daily",
)
def daily_sum(spark, sf_dir):
    per_day = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    return per_day.select(day("dt"), rnd("label", 2))


@query(
    "daily_sum_by_series",
    f"""WITH {NATION_SQL}
SELECT nation, CAST(dt AS VARCHAR) AS dt, {r('label', 2, 'label')} FROM nation_daily""",
)
def daily_sum_by_series(spark, sf_dir):
    per_day = series.daily_sum(nation_sales(spark, sf_dir), "dt", "o_totalprice", ["nation"])
    return per_day.select("nation", day("dt"), rnd("label", 2))


@query(
    "future_days",
    f"WITH {FUTURE_SQL} SELECT CAST(dt AS VARCHAR) AS dt, {r('label', 2, 'label')} FROM spine",
)
def future_days(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N)
    return rows.select(day("dt"), rnd("label", 2))


@query(
    "fill_days",
    f"""WITH {NATION_SQL},
span AS (SELECT nation, MIN(dt) AS lo, MAX(dt) AS hi FROM nation_daily GROUP BY nation),
spine AS (SELECT nation, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt FROM span)
SELECT s.nation, CAST(s.dt AS VARCHAR) AS dt, {r('d.label', 2, 'label')}
FROM spine s LEFT JOIN nation_daily d ON d.nation = s.nation AND d.dt = s.dt""",
)
def fill_days(spark, sf_dir):
    per_day = series.daily_sum(nation_sales(spark, sf_dir), "dt", "o_totalprice", ["nation"])
    return series.fill_days(per_day, ["nation"]).select("nation", day("dt"), rnd("label", 2))


@query(
    "smooth_outliers",
    f"""WITH {FUTURE_SQL},
near AS (SELECT dt, label, (LAG(label, 7) OVER w + LEAD(label, 7) OVER w) / 2.0 AS mean
         FROM spine WINDOW w AS (ORDER BY dt))
SELECT CAST(dt AS VARCHAR) AS dt, {r('label', 2, 'label')},
       {r('''CASE WHEN mean IS NULL OR label IS NULL THEN NULL
             WHEN label / mean >= 1.9 OR label / mean <= 0.7 THEN mean ELSE label END''', 4, 'label_smooth')}
FROM near""",
)
def smooth_outliers(spark, sf_dir):
    rows = series.smooth_outliers(series.add_future_days(daily(spark, sf_dir), N))
    return rows.select(day("dt"), rnd("label", 2), rnd("label_smooth", 4))


@query(
    "last_same_day",
    f"""WITH {FUTURE_SQL}, {CALENDAR_SQL}, {aligned_sql('spine', 1, 'one')}, {aligned_sql('spine', 2, 'two')}
SELECT CAST(one.dt AS VARCHAR) AS dt, CAST(one.day AS VARCHAR) AS one_year,
       CAST(two.day AS VARCHAR) AS two_years FROM one JOIN two ON one.dt = two.dt""",
)
def last_same_day(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N)
    one = dates.same_day_years_back("dt", 1, CALENDAR)
    two = dates.same_day_years_back("dt", 2, CALENDAR)
    return rows.select(
        day("dt"), one.cast("string").alias("one_year"), two.cast("string").alias("two_years")
    )


@query(
    "aligned_labels",
    f"""WITH {FUTURE_SQL}, {CALENDAR_SQL}, {aligned_sql('spine', 1, 'one')}, {aligned_sql('spine', 2, 'two')}
SELECT CAST(one.dt AS VARCHAR) AS dt, {r('a.label', 2, 'last_1_year_label')},
       {r('b.label', 2, 'last_2_year_label')}, {r('a.label + b.label', 2, 'last_2_year_mean_label')}
FROM one JOIN two ON two.dt = one.dt
LEFT JOIN daily a ON a.dt = one.day LEFT JOIN daily b ON b.dt = two.day""",
)
def aligned_labels(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N)
    rows = series.add_aligned(rows, 1, "last_1_year_label", calendar=CALENDAR)
    rows = series.add_aligned(rows, 2, "last_2_year_label", calendar=CALENDAR)
    both = F.col("last_1_year_label") + F.col("last_2_year_label")
    return rows.select(
        day("dt"), rnd("last_1_year_label", 2), rnd("last_2_year_label", 2),
        rnd(both, 2, "last_2_year_mean_label"),
    )


@query(
    "trailing_sum",
    f"""WITH {FUTURE_SQL}
SELECT CAST(dt AS VARCHAR) AS dt, {r(trailing_sql('s.dt'), 2, 'label_7d_mean')} FROM spine s""",
)
def trailing_sum(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N)
    rows = series.add_trailing_sum(rows, 7, N, "label_7d_mean")
    return rows.select(day("dt"), rnd("label_7d_mean", 2))


YOY_SQL = f"""WITH {FUTURE_SQL}, {CALENDAR_SQL}, {aligned_sql('spine', 1, 'one')},
sums AS (
  SELECT one.dt, {trailing_sql('one.dt')} AS now, a.label AS old_label,
         CASE WHEN one.day IS NOT NULL THEN {trailing_sql('one.day')} END AS old
  FROM one LEFT JOIN daily a ON a.dt = one.day)
SELECT CAST(dt AS VARCHAR) AS dt, {r('old', 2, 'last_1_year_label_7d_mean')},
       {r('now / NULLIF(old, 0)', 8, 'label_7d_mean_uplift')},
       {r('old_label * (now / NULLIF(old, 0))', 4, 'last_1_year_label_fix')} FROM sums"""


@query("yoy_growth", YOY_SQL)
def yoy_growth(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N)
    rows = series.add_trailing_sum(rows, 7, N, "label_7d_mean")
    rows = series.add_aligned(
        rows, 1, "last_1_year_label", "last_1_year_label_7d_mean", 7, N, calendar=CALENDAR
    )
    rows = series.add_growth(rows.withColumn("last_2_year_label", F.lit(0.0)))
    return rows.select(
        day("dt"), rnd("last_1_year_label_7d_mean", 2), rnd("label_7d_mean_uplift", 8),
        rnd("last_1_year_label_fix", 4),
    )


ROLL = f"OVER (ORDER BY dt ROWS BETWEEN {6 + N} PRECEDING AND {N} PRECEDING)"


@query(
    "rolling_stats",
    f"""WITH {FUTURE_SQL}
SELECT CAST(dt AS VARCHAR) AS dt, {r(f'MIN(label) {ROLL}', 2, 'stat_min')},
       {r(f'MAX(label) {ROLL}', 2, 'stat_max')}, {r(f'AVG(label) {ROLL}', 4, 'stat_mean')},
       {r(f'STDDEV_SAMP(label) {ROLL}', 4, 'stat_std')},
       {r(f'QUANTILE_CONT(label, 0.5) {ROLL}', 4, 'stat_median')} FROM spine""",
)
def rolling_stats(spark, sf_dir):
    rows = series.add_rolling_stats(series.add_future_days(daily(spark, sf_dir), N), N)
    return rows.select(
        day("dt"), rnd("stat_min", 2), rnd("stat_max", 2), rnd("stat_mean", 4),
        rnd("stat_std", 4), rnd("stat_median", 4),
    )


def lag_sql(i: int) -> str:
    return f"LAG(label, {i}) OVER (ORDER BY dt)"


@query(
    "lags_diffs_ratios",
    f"WITH {FUTURE_SQL} SELECT CAST(dt AS VARCHAR) AS dt, "
    + ", ".join(
        [r(lag_sql(N + o), 2, f"sale_lag_{N + o}") for o in (0, 1, 2, 3, 6)]
        + [r(f"{lag_sql(i + 1)} - {lag_sql(i)}", 2, f"sale_fod_{i}") for i in range(N, N + 3)]
        + [
            r(f"{lag_sql(i + 1)} / NULLIF({lag_sql(i)}, 0)", 8, f"sale_huanbi_{i}")
            for i in range(N, N + 3)
        ]
    )
    + " FROM spine",
)
def lags_diffs_ratios(spark, sf_dir):
    rows = series.add_lags(series.add_future_days(daily(spark, sf_dir), N), N)
    return rows.select(
        day("dt"),
        *[rnd(f"sale_lag_{N + o}", 2) for o in (0, 1, 2, 3, 6)],
        *[rnd(f"sale_fod_{i}", 2) for i in range(N, N + 3)],
        *[rnd(f"sale_huanbi_{i}", 8) for i in range(N, N + 3)],
    )


@query(
    "lead_labels",
    f"WITH {DAILY_SQL} SELECT CAST(dt AS VARCHAR) AS dt, "
    + ", ".join(r(f"LEAD(label, {i}) OVER (ORDER BY dt)", 2, f"y{i}_real") for i in (1, 2, 3))
    + " FROM daily",
)
def lead_labels(spark, sf_dir):
    rows = series.add_future_labels(daily(spark, sf_dir), 3, mark="y")
    return rows.select(day("dt"), *[rnd(f"y{i}_real", 2) for i in (1, 2, 3)])


@query(
    "calendar_features",
    f"""WITH {FUTURE_SQL}
SELECT CAST(dt AS VARCHAR) AS dt, CAST(year(dt) AS INT) AS year_int, CAST(month(dt) AS INT) AS month_int,
       CAST(day(dt) AS INT) AS day_int, CAST(quarter(dt) AS INT) AS quarter_int,
       CAST(weekofyear(dt) AS INT) AS weekofyear_int, CAST(dayofyear(dt) AS INT) AS day_of_year_int,
       CAST(isodow(dt) - 1 AS INT) AS weekday_int,
       CAST(dayofyear(dt) = 1 AS INT) AS is_year_start_bool,
       CAST(dt = date_trunc('quarter', dt) AS INT) AS is_quarter_start_bool,
       CAST(day(dt) = 1 AS INT) AS is_month_start_bool,
       CAST(dt = last_day(dt) AS INT) AS is_month_end_bool,
       CAST(isodow(dt) IN (6, 7) AS INT) AS is_weekend_bool FROM spine""",
)
def calendar_features(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N).select("dt")
    return dates.add_calendar_parts(rows).withColumn("dt", F.col("dt").cast("string"))


@query(
    "holiday_distances",
    f"""WITH {FUTURE_SQL}, {CALENDAR_SQL}
SELECT CAST(dt AS VARCHAR) AS dt, CAST(c.fest - dt AS INT) AS day_to_spring_int,
       CAST(make_date(year(dt), 5, 1) - dt AS INT) AS day_to_0501_int,
       CAST(make_date(year(dt), 6, 18) - dt AS INT) AS day_to_0618_int,
       CAST(make_date(year(dt), 10, 1) - dt AS INT) AS day_to_1001_int,
       CAST(make_date(year(dt), 11, 11) - dt AS INT) AS day_to_1111_int,
       CAST(isodow(dt) IN (6, 7) AS INT) AS is_weekend_bool
FROM spine LEFT JOIN cal c ON c.year = year(dt)""",
)
def holiday_distances(spark, sf_dir):
    rows = series.add_future_days(daily(spark, sf_dir), N).select("dt")
    return dates.add_distance_parts(rows, "dt", CALENDAR).withColumn("dt", F.col("dt").cast("string"))


def level_sql(levels) -> str:
    return ", ".join(f"NULLIF(COUNT(pid) FILTER (price_level = '{v}'), 0) AS \"{v}\"" for v in levels)


def brand_sql(brands, levels) -> str:
    return ", ".join(
        f"NULLIF(COUNT(pid) FILTER (price_level = '{v}' AND dim_prd_brand = '{b}'), 0) AS \"{b}_{v}\""
        for b in brands
        for v in levels
    )


@query(
    "price_level_pivot",
    f"WITH {PRICE_SQL} SELECT plan_date AS dt, {level_sql(LEVELS)} FROM price GROUP BY 1",
)
def price_level_pivot(spark, sf_dir):
    wide = series.level_pivot(price_level(spark, sf_dir), LEVELS)
    return wide.withColumn("dt", F.col("dt").cast("string"))


@query(
    "brand_level_pivot",
    f"WITH {PRICE_SQL} SELECT plan_date AS dt, {brand_sql(BRANDS, LEVELS)} FROM price GROUP BY 1",
)
def brand_level_pivot(spark, sf_dir):
    wide = series.brand_level_pivot(price_level(spark, sf_dir), LEVELS, BRANDS)
    return wide.withColumn("dt", F.col("dt").cast("string"))


@query(
    "price_level_counts",
    f"""WITH {PRICE_SQL}
SELECT plan_date AS dt, {level_sql(LEVELS)}, {brand_sql(BRANDS, LEVELS)} FROM price GROUP BY 1""",
)
def price_level_counts(spark, sf_dir):
    wide = series.price_level_counts(price_level(spark, sf_dir), LEVELS, BRANDS)
    return wide.withColumn("dt", F.col("dt").cast("string"))


@query(
    "bind_days",
    f"""WITH {PRICE_SQL}, {DAILY_SQL},
counts AS (SELECT CAST(plan_date AS DATE) AS dt, COUNT(pid) AS items FROM price GROUP BY 1)
SELECT CAST(COALESCE(d.dt, c.dt) AS VARCHAR) AS dt, {r('d.label', 2, 'label')}, c.items
FROM daily d FULL JOIN counts c ON c.dt = d.dt""",
)
def bind_days(spark, sf_dir):
    items = (
        price_level(spark, sf_dir)
        .groupBy(F.col("plan_date").cast("date").alias("dt"))
        .agg(F.count("pid").alias("items"))
    )
    both = series.bind_days(daily(spark, sf_dir), items)
    return both.select(day("dt"), rnd("label", 2), "items")


def feature_sql(source: str, spine: str, key: str = "") -> str:
    """SQL for every forecast feature; ``key`` is the series column, if there is one."""
    k, on = (f"{key}, ", f" AND d.{key} = one.{key}") if key else ("", "")
    part = f"PARTITION BY {key} " if key else ""
    same = f" AND x.{key} = y.{key}" if key else ""
    roll = f"OVER ({part}ORDER BY dt ROWS BETWEEN {6 + N} PRECEDING AND {N} PRECEDING)"

    def lag(i: int) -> str:
        return f"LAG(label, {i}) OVER ({part}ORDER BY dt)"

    def trailing(day_sql: str) -> str:
        return (
            f"COALESCE((SELECT SUM(d.label) FROM {source} d WHERE d.dt BETWEEN {day_sql} - {2 * N + 6} "
            f"AND {day_sql} - {N}{on}), 0)"
        )

    def back(years: int, name: str) -> str:
        return f"""{name} AS (
  SELECT {('s.' + key + ', ') if key else ''}s.dt,
         CASE WHEN c.year IS NULL THEN CAST(s.dt - INTERVAL {years} YEAR AS DATE)
              ELSE CAST(p.fest - CAST(c.fest - s.dt AS INT) AS DATE) END AS day
  FROM {spine} s LEFT JOIN cal c ON ABS(c.fest - s.dt) <= 21 LEFT JOIN cal p ON p.year = c.year - {years})"""

    def match(left: str, day_sql: str, right: str) -> str:
        keyed = f" AND {right}.{key} = {left}.{key}" if key else ""
        return f"{right}.dt = {day_sql}{keyed}"

    offsets, steps = (0, 1, 2, 3, 6), range(N, N + 3)
    columns = [r("l.label", 2, "label"), "CAST(isodow(l.dt) - 1 AS INT) AS weekday"]
    columns += [
        r("""CASE WHEN l.mean IS NULL OR l.label IS NULL THEN NULL
             WHEN l.mean = 0 THEN CASE WHEN l.label <> 0 THEN 0 END
             WHEN l.label / l.mean >= 1.9 OR l.label / l.mean <= 0.7 THEN l.mean ELSE l.label END""",
          4, "label_smooth"),
        r("old_label", 2, "last_1_year_label"), r("older_label", 2, "last_2_year_label"),
        r("old_label + older_label", 2, "last_2_year_mean_label"),
        r("old", 2, "last_1_year_label_7d_mean"), r("now", 2, "label_7d_mean"),
        r("now / NULLIF(old, 0)", 6, "label_7d_mean_uplift"),
        r("old_label * (now / NULLIF(old, 0))", 3, "last_1_year_label_fix"),
        "CAST(quarter(l.dt) AS INT) AS quarter_int",
        "CAST(isodow(l.dt) IN (6, 7) AS INT) AS is_weekend_bool",
        "CAST(cal.fest - l.dt AS INT) AS day_to_spring_int",
    ]
    columns += [
        f"CAST(make_date(year(l.dt), {m}, {d}) - l.dt AS INT) AS day_to_{name}_int"
        for name, (m, d) in dates.SALES_DAYS.items()
    ]
    columns += ["CAST(month(l.dt) AS INT) AS month_int"]
    columns += [r(f"stat_{c}", 5, f"stat_{c}") for c in ("min", "max", "mean", "std", "median")]
    columns += [r(f"lag_{o}", 2, f"sale_lag_{N + o}") for o in offsets]
    columns += [r(f"lag_{i - N + 1} - lag_{i - N}", 2, f"sale_fod_{i}") for i in steps]
    columns += [
        r(f"lag_{i - N + 1} / NULLIF(lag_{i - N}, 0)", 6, f"sale_huanbi_{i}") for i in steps
    ]
    return f"""{back(1, 'one')}, {back(2, 'two')},
lagged AS (
  SELECT {k}dt, label, MIN(label) {roll} AS stat_min, MAX(label) {roll} AS stat_max,
         AVG(label) {roll} AS stat_mean, STDDEV_SAMP(label) {roll} AS stat_std,
         QUANTILE_CONT(label, 0.5) {roll} AS stat_median,
         ({lag(7)} + LEAD(label, 7) OVER ({part}ORDER BY dt)) / 2.0 AS mean,
         {', '.join(f'{lag(N + o)} AS lag_{o}' for o in offsets)} FROM {spine}),
sums AS (
  SELECT {'one.' + key + ', ' if key else ''}one.dt, {trailing('one.dt')} AS now,
         a.label AS old_label, b.label AS older_label,
         CASE WHEN one.day IS NOT NULL THEN {trailing('one.day')} END AS old
  FROM one JOIN two ON {match('one', 'one.dt', 'two')}
  LEFT JOIN {source} a ON {match('one', 'one.day', 'a')}
  LEFT JOIN {source} b ON {match('two', 'two.day', 'b')}),
features AS (
  SELECT {'l.' + key + ', ' if key else ''}CAST(l.dt AS VARCHAR) AS dt, {', '.join(columns)}
  FROM lagged l JOIN sums s ON {match('l', 'l.dt', 's')} LEFT JOIN cal ON cal.year = year(l.dt))"""


MONEY = ["label", "last_1_year_label", "last_2_year_label", "last_2_year_mean_label",
         "last_1_year_label_7d_mean", "label_7d_mean"]


def rounded_features(rows, keep=(), extra=()):
    """Every feature, rounded for the check."""
    digits = {"label_smooth": 4, "label_7d_mean_uplift": 6, "last_1_year_label_fix": 3}
    digits |= {c: 2 for c in rows.columns if c in MONEY or c.startswith(("sale_lag", "sale_fod"))}
    digits |= {c: 6 for c in rows.columns if c.startswith("sale_huanbi")}
    digits |= {c: 5 for c in rows.columns if c.startswith("stat_")}
    return rows.select(
        *keep, day("dt"),
        *[rnd(c, digits[c]) if c in digits else c
          for c in rows.columns if c not in ("dt", *keep, *extra)],
        *extra,
    )


@query(
    "feature_v8",
    f"""WITH {FUTURE_SQL}, {CALENDAR_SQL}, {PRICE_SQL},
counts AS (SELECT plan_date, {level_sql(LEVELS)}, {brand_sql(BRANDS, LEVELS)} FROM price GROUP BY 1),
{feature_sql('daily', 'spine')}
SELECT f.*, c.* EXCLUDE (plan_date) FROM features f LEFT JOIN counts c ON c.plan_date = f.dt""",
)
def feature_v8(spark, sf_dir):
    """The whole feature set with price levels, and those of every brand."""
    rows = series.priced_features(
        gmv(spark, sf_dir), price_level(spark, sf_dir), N, LEVELS, BRANDS, calendar=CALENDAR
    )
    return rounded_features(rows, extra=[*LEVELS, *[f"{b}_{v}" for b in BRANDS for v in LEVELS]])


@query(
    "feature_v3_by_series",
    f"""WITH {NATION_SQL}, {CALENDAR_SQL},
span AS (SELECT nation, MIN(dt) AS lo, MAX(dt) AS hi FROM nation_daily GROUP BY nation),
spine AS (
  SELECT s.nation, s.dt, d.label
  FROM (SELECT nation, CAST(UNNEST(generate_series(lo, hi + {N}, INTERVAL 1 DAY)) AS DATE) AS dt FROM span) s
  LEFT JOIN nation_daily d ON d.nation = s.nation AND d.dt = s.dt),
{feature_sql('nation_daily', 'spine', 'nation')}
SELECT * FROM features""",
)
def feature_v3_by_series(spark, sf_dir):
    """Every feature, one series per nation, missing days filled."""
    rows = series.daily_features(
        nation_sales(spark, sf_dir), N, "dt", "o_totalprice", ["nation"], CALENDAR, densify=True
    )
    return rounded_features(rows, ["nation"])


@query(
    "tail_split",
    f"""WITH {DAILY_SQL},
ahead AS (SELECT dt, label, LEAD(label, 1) OVER (ORDER BY dt) AS y1 FROM daily),
backward AS (SELECT *, ROW_NUMBER() OVER (ORDER BY dt DESC) AS back FROM ahead WHERE y1 IS NOT NULL)
SELECT CAST(dt AS VARCHAR) AS dt, CASE WHEN back <= 30 THEN 'test' ELSE 'train' END AS split
FROM backward WHERE back <= 30 OR back > 37""",
)
def tail_split(spark, sf_dir):
    rows = series.add_future_labels(daily(spark, sf_dir), 1, mark="y")
    return splits.tail_split(rows, 30, 7, ["y1_real"]).select(day("dt"), "split")


@query(
    "date_split",
    f"""WITH {FUTURE_SQL}, lim AS (SELECT MAX(dt) AS d FROM daily)
SELECT CAST(dt AS VARCHAR) AS dt,
       CASE WHEN dt > d THEN 'predict' WHEN dt > d - 3 THEN 'test'
            WHEN dt BETWEEN d - 305 AND d - 6 THEN 'valid'
            WHEN dt <= d - 309 THEN 'train' END AS split
FROM spine, lim""",
)
def date_split(spark, sf_dir):
    per_day = daily(spark, sf_dir)
    start, end = splits.series_span(per_day)
    plan = splits.DatePlan(start, end, N, 300, product=True, gap=True)
    rows = series.add_future_days(per_day, N)
    return splits.label_spans(rows, plan).select(day("dt"), "split")


@query(
    "split_frames",
    f"""WITH {DAILY_SQL}, lim AS (SELECT MAX(dt) AS d FROM daily),
future AS (SELECT label, dt FROM daily UNION ALL SELECT NULL, d + CAST(UNNEST(range(1, {N + 1})) AS INT) FROM lim),
named AS (SELECT label, CASE WHEN dt > d THEN 'predict' WHEN dt > d - 3 THEN 'test' WHEN dt > d - 303 THEN 'valid' ELSE 'train' END AS span
          FROM future, lim)
SELECT span, COUNT(*) AS n, {r('SUM(label)', 1, 'label')} FROM named GROUP BY span""",
)
def split_frames(spark, sf_dir):
    """All four spans, the days to predict included; the input is read once for all of them."""
    per_day = series.add_future_days(daily(spark, sf_dir), N)
    start, end = splits.series_span(per_day)
    frames_ = splits.split_frames(per_day, splits.DatePlan(start, end, N, 300, product=True), [], "label")
    rows = frames.unite([df.withColumn("span", F.lit(name)) for name, df in frames_.items()])
    return rows.groupBy("span").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("label"), 1, "label")
    )


@query(
    "keep_until",
    """SELECT COUNT(*) AS n, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last
FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'""",
)
def keep_until(spark, sf_dir):
    tables = {"gmv_real_data": gmv(spark, sf_dir), "price_level": price_level(spark, sf_dir)}
    kept = splits.keep_until(
        tables, dt.date(1998, 12, 31), {"gmv_real_data": "ancestor_order_create_dt"}
    )
    return kept["gmv_real_data"].agg(
        F.count(F.lit(1)).alias("n"), F.max("ancestor_order_create_dt").alias("last")
    )


@query(
    "last_row_per_series",
    f"""WITH {NATION_SQL}
SELECT nation, CAST(MAX(dt) AS VARCHAR) AS dt, {r('ARG_MAX(label, dt)', 2, 'label')}
FROM nation_daily GROUP BY nation""",
)
def last_row_per_series(spark, sf_dir):
    per_day = series.daily_sum(nation_sales(spark, sf_dir), "dt", "o_totalprice", ["nation"])
    return splits.last_rows(per_day, keys=["nation"]).select("nation", day("dt"), rnd("label", 2))


@query(
    "duplicate_days",
    """SELECT c_nationkey AS nation, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, COUNT(*) AS n
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def duplicate_days(spark, sf_dir):
    found = checks.duplicate_days(nation_sales(spark, sf_dir), "dt", ["nation"])
    return found.select("nation", day("dt"), "n")


@query(
    "missing_days",
    """WITH span AS (
  SELECT c_nationkey AS nation, MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
spine AS (SELECT nation, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt FROM span)
SELECT nation, CAST(dt AS VARCHAR) AS dt FROM spine
WHERE (nation, dt) NOT IN (SELECT c_nationkey, CAST(o_orderdate AS DATE)
                           FROM orders JOIN customer ON c_custkey = o_custkey)""",
)
def missing_days(spark, sf_dir):
    found = checks.missing_days(nation_sales(spark, sf_dir), "dt", ["nation"])
    return found.select("nation", day("dt"))


@query(
    "day_coverage",
    """SELECT c_nationkey AS nation, COUNT(*) AS n_rows, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n_days,
       CAST(MAX(CAST(o_orderdate AS DATE)) - MIN(CAST(o_orderdate AS DATE)) + 1 AS BIGINT) AS n_span,
       0 AS complete
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def day_coverage(spark, sf_dir):
    return checks.day_coverage(nation_sales(spark, sf_dir), "dt", ["nation"])


@query(
    "row_index",
    f"""WITH {NATION_SQL}
SELECT nation, CAST(dt AS VARCHAR) AS dt,
       CAST(ROW_NUMBER() OVER (PARTITION BY nation ORDER BY dt) - 1 AS INT) AS time_idx
FROM nation_daily""",
)
def row_index(spark, sf_dir):
    per_day = series.daily_sum(nation_sales(spark, sf_dir), "dt", "o_totalprice", ["nation"])
    return checks.number_rows(per_day, keys=["nation"]).select("nation", day("dt"), "time_idx")


@query(
    "value_span",
    """SELECT CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR) AS lo,
       CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS hi,
       COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n_distinct FROM orders""",
)
def value_span(spark, sf_dir):
    return checks.value_span(gmv(spark, sf_dir), "ancestor_order_create_dt")
