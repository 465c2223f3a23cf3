"""Hand-computed edge cases of the daily series."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortcast.functions import dates
from cohortcast.operators import checks, series, splits

CAL = {1999: dt.date(1999, 2, 16), 2000: dt.date(2000, 2, 5), 2023: dt.date(2023, 1, 22),
       2024: dt.date(2024, 2, 10)}


def _days(spark, start, labels):
    first = dt.date.fromisoformat(start)
    rows = [(first + dt.timedelta(days=i), v) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "dt date, label double")


@pytest.mark.parametrize(
    "day,want",
    [
        ("2000-02-26", "1999-03-09"),  # 21 days after the festival: the distance is kept
        ("2000-02-27", "1999-02-27"),  # 22 days after: same month and day
        ("2000-01-15", "1999-01-26"),  # 21 days before
        ("2000-06-30", "1999-06-30"),
        ("1999-02-20", None),  # near a festival, none a year earlier
        ("2024-02-29", None),  # 19 days after the festival of 2024: as far after that of 2023
    ],
)
def test_same_day_years_back(spark, day, want):
    if day == "2024-02-29":
        want = "2023-02-10"
    row = spark.range(1).select(
        dates.same_day_years_back(F.lit(dt.date.fromisoformat(day)), 1, CAL).alias("d")
    ).first()
    assert row["d"] == (dt.date.fromisoformat(want) if want else None)


def test_leap_day_without_festival(spark):
    row = spark.range(1).select(
        dates.same_day_years_back(F.lit(dt.date(2020, 2, 29)), 1, CAL).alias("d")
    ).first()
    assert row["d"] == dt.date(2019, 2, 28)


def test_festival_across_new_year(spark):
    """22 January 2023 is 21 days after 1 January; 31 December 2022 is 22 days before it."""
    shift = dates.same_day_years_back(F.col("d"), 1, {2022: dt.date(2022, 2, 1), **CAL})
    rows = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2022, 12, 31),)], "d date")
    got = [r[0] for r in rows.select(shift).collect()]
    assert got == [dt.date(2022, 1, 11), dt.date(2021, 12, 31)]


def test_rolling_frame_with_a_null(spark):
    rows = series.add_rolling_stats(_days(spark, "2024-01-01", [1.0, None, 5.0, 3.0]), 1)
    got = [(r["stat_min"], r["stat_max"], r["stat_mean"], r["stat_median"], r["stat_std"])
           for r in rows.orderBy("dt").collect()]
    assert got[0] == (None,) * 5
    assert got[1] == (1.0, 1.0, 1.0, 1.0, None)
    assert got[2] == got[1]
    assert got[3][:4] == (1.0, 5.0, 3.0, 3.0)


def test_ratio_with_zero_divisor(spark):
    rows = series.add_lags(_days(spark, "2024-01-01", [4.0, 0.0, 2.0, 1.0]), 1)
    last = rows.orderBy(F.desc("dt")).first()
    assert last["sale_huanbi_1"] == 0.0 and last["sale_huanbi_2"] is None
    assert last["sale_fod_1"] == -2.0


def test_smoothing(spark):
    labels = [10.0] * 15
    labels[7] = 30.0
    rows = series.smooth_outliers(_days(spark, "2024-01-01", labels)).orderBy("dt").collect()
    assert rows[7]["label_smooth"] == 10.0
    assert rows[6]["label_smooth"] is None and rows[8]["label_smooth"] is None
    zero = [0.0] * 15
    zero[7] = 2.0
    rows = series.smooth_outliers(_days(spark, "2024-01-01", zero)).orderBy("dt").collect()
    assert rows[7]["label_smooth"] == 0.0


def test_trailing_sum_spans_calendar_days(spark):
    daily = _days(spark, "2024-01-01", [1.0] * 30).filter("day(dt) <> 10")
    rows = series.add_trailing_sum(daily, 7, 2, "s")
    got = {r["dt"].day: r["s"] for r in rows.collect()}
    assert got[1] == 0.0 and got[3] == 1.0
    assert got[20] == 8.0  # 10th to 18th, the 10th is missing
    assert got[30] == 9.0


def test_checks(spark):
    daily = _days(spark, "2024-01-01", [1.0, 2.0, 3.0, 4.0])
    assert checks.require_daily(daily.withColumn("x", F.lit(1)), drop=["x"]).agg(
        F.max("time_idx")
    ).first()[0] == 3
    with pytest.raises(ValueError, match="missing"):
        checks.require_daily(daily.filter("label <> 2"))
    with pytest.raises(ValueError, match="twice"):
        checks.require_daily(daily.unionByName(daily.limit(1)))
    with pytest.raises(ValueError):
        checks.require_columns(daily, ["nope"])


def test_date_plan():
    plan = splits.DatePlan(dt.date(2024, 1, 1), dt.date(2024, 12, 31), 5, 30, True, True)
    d = plan.dates()
    assert (d["test_start_dt"], d["test_end_dt"]) == ("2024-12-27", "2024-12-31")
    assert (d["valid_start_dt"], d["valid_end_dt"]) == ("2024-11-22", "2024-12-21")
    assert (d["train_start_dt"], d["train_end_dt"]) == ("2024-01-01", "2024-11-16")
    assert (d["predict_start_dt"], d["predict_end_dt"]) == ("2025-01-01", "2025-01-05")
    assert plan.info()["train_valid_gap"] == 5 and plan.info()["test_valid_gap"] == 5
    with pytest.raises(ValueError):
        splits.DatePlan(dt.date(2024, 1, 1), dt.date(2024, 1, 31), 5, 30).spans()


def test_clean_names_clash(spark):
    with pytest.raises(ValueError, match="clash"):
        series.clean_names(spark.range(1).selectExpr("id as `a,b`", "id as `a/b`"))
