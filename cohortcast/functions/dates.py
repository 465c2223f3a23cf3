"""Day arithmetic, calendar parts and festival alignment as column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.hashing import as_column

# Spring Festival dates the forecast features are aligned to.
SPRING_FESTIVAL = {
    2024: dt.date(2024, 2, 10),
    2025: dt.date(2025, 1, 29),
}

# Sales days (month, day) whose distance is a feature.
SALES_DAYS = {
    "0501": (5, 1),
    "0618": (6, 18),
    "1001": (10, 1),
    "1111": (11, 11),
}

ALIGN_DAYS = 21


def run_dates(run_date: dt.date | None = None) -> tuple[str, str]:
    """(today, yesterday) as text; the run date is a parameter so that a rerun reads the same day."""
    today = run_date or dt.date.today()
    return today.isoformat(), (today - dt.timedelta(days=1)).isoformat()


def day_text(day: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(as_column(day), fmt)


def text_day(text: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Day from text, NULL where the text is no day."""
    return F.try_to_timestamp(as_column(text), F.lit(fmt)).cast("date")


def text_days(texts: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Array of texts to an array of days."""
    return F.transform(as_column(texts), lambda t: F.try_to_timestamp(t, F.lit(fmt)).cast("date"))


def first_ten(value: str | Column) -> Column:
    """The day part of a timestamp's text."""
    return F.substring(as_column(value).cast("string"), 1, 10)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Array of every day from start to end, both included."""
    return F.sequence(as_column(start).cast("date"), as_column(end).cast("date"))


def day_range(df: DataFrame, start: str | Column, end: str | Column, name: str = "dt") -> DataFrame:
    """One row per day between two columns of ``df``."""
    return df.withColumn(name, F.explode(days_between(start, end)))


def add_calendar_parts(df: DataFrame, day: str = "dt") -> DataFrame:
    """Year, month, day, quarter, week, weekday (Monday = 0) and period-edge flags."""
    d = F.col(day)
    return df.withColumns(
        {
            "year_int": F.year(d),
            "month_int": F.month(d),
            "day_int": F.dayofmonth(d),
            "quarter_int": F.quarter(d),
            "weekofyear_int": F.weekofyear(d),
            "day_of_year_int": F.dayofyear(d),
            "weekday_int": F.weekday(d),
            "is_year_start_bool": (F.dayofyear(d) == 1).cast("int"),
            "is_quarter_start_bool": (d == F.trunc(d, "quarter")).cast("int"),
            "is_month_start_bool": (F.dayofmonth(d) == 1).cast("int"),
            "is_month_end_bool": (d == F.last_day(d)).cast("int"),
            "is_weekend_bool": F.weekday(d).isin(5, 6).cast("int"),
        }
    )


def festival_of(year: Column, calendar: Mapping[int, dt.date]) -> Column:
    """Festival date of a year, NULL for years the calendar lacks. One map entry per year."""
    entries = [F.lit(v) for y, day in sorted(calendar.items()) for v in (y, day)]
    return F.try_element_at(F.create_map(*entries), year)


def days_to_festival(day: str | Column, calendar: Mapping[int, dt.date] = SPRING_FESTIVAL) -> Column:
    """Signed days from ``day`` to the festival of the same year."""
    d = as_column(day)
    return F.datediff(festival_of(F.year(d), calendar), d)


def days_to_month_day(day: str | Column, month: int, dom: int) -> Column:
    """Signed days from ``day`` to a fixed month and day of the same year."""
    d = as_column(day)
    return F.datediff(F.make_date(F.year(d), F.lit(month), F.lit(dom)), d)


def add_distance_parts(
    df: DataFrame, day: str = "dt", calendar: Mapping[int, dt.date] = SPRING_FESTIVAL
) -> DataFrame:
    """Distances to the festival and to the fixed sales days, and the weekend flag."""
    columns = {"day_to_spring_int": days_to_festival(day, calendar)}
    for name, (month, dom) in SALES_DAYS.items():
        columns[f"day_to_{name}_int"] = days_to_month_day(day, month, dom)
    columns["is_weekend_bool"] = F.weekday(F.col(day)).isin(5, 6).cast("int")
    return df.withColumns(columns)


def same_day_years_back(
    day: str | Column,
    years: int,
    calendar: Mapping[int, dt.date] = SPRING_FESTIVAL,
    align_days: int = ALIGN_DAYS,
) -> Column:
    """The comparable day ``years`` earlier.

    Near a festival the distance to that festival is kept, so the day is NULL when the calendar has
    no festival so far back. Elsewhere it is the same month and day; 29 February becomes the 28th.
    """
    d = as_column(day)
    year = F.year(d)

    def near(y: Column) -> Column:
        return F.when(F.abs(F.datediff(festival_of(y, calendar), d)) <= align_days, y)

    festival_year = F.coalesce(near(year), near(year + 1), near(year - 1))
    shifted = F.date_sub(
        festival_of(festival_year - years, calendar),
        F.datediff(festival_of(festival_year, calendar), d),
    )
    return F.when(festival_year.isNotNull(), shifted).otherwise(F.add_months(d, -12 * years))
