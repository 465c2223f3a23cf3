"""Time splits: by date plan and by tail rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.session import stage_parts


@dataclass(frozen=True)
class DatePlan:
    """Train, valid, test and predict spans around the last labelled day.

    With D the last day, n the horizon, v the validation days and g = n if ``gap`` else 0: test is
    the last n days, valid the v days that end g days before test, train everything that ends g days
    before valid, predict the n days after D (only with ``product``).
    """

    start: dt.date
    end: dt.date
    horizon: int
    valid_days: int
    product: bool = False
    gap: bool = False

    def spans(self) -> dict[str, tuple[dt.date, dt.date]]:
        one = dt.timedelta(days=1)
        gap = dt.timedelta(days=self.horizon if self.gap else 0)
        test_start = self.end - dt.timedelta(days=self.horizon) + one
        valid_end = test_start - gap - one
        valid_start = valid_end - dt.timedelta(days=self.valid_days) + one
        train_end = valid_start - gap - one
        if train_end < self.start:
            raise ValueError("the series is too short for this plan")
        spans = {
            "train": (self.start, train_end),
            "valid": (valid_start, valid_end),
            "test": (test_start, self.end),
        }
        if self.product:
            spans["predict"] = (self.end + one, self.end + dt.timedelta(days=self.horizon))
        return spans

    def info(self) -> dict[str, object]:
        """Lengths of the spans and the days between them."""
        spans = self.spans()
        length = {k: (b - a).days + 1 for k, (a, b) in spans.items()}
        return {
            "data_start_dt": self.start.isoformat(),
            "data_end_dt": self.end.isoformat(),
            "predict_next_nd": self.horizon,
            "valid_day_cnt": self.valid_days,
            "product": self.product,
            "train_length": length["train"],
            "valid_length": length["valid"],
            "test_length": length["test"],
            "predict_length": length.get("predict", 0),
            "train_valid_gap": (spans["valid"][0] - spans["train"][1]).days - 1,
            "test_valid_gap": (spans["test"][0] - spans["valid"][1]).days - 1,
        }

    def dates(self) -> dict[str, str | None]:
        """Start and end of every span as text."""
        spans, out = self.spans(), {}
        for name in ("train", "valid", "test", "predict"):
            low, high = spans.get(name, (None, None))
            out[f"{name}_start_dt"] = low and low.isoformat()
            out[f"{name}_end_dt"] = high and high.isoformat()
        return out


def label_spans(df: DataFrame, plan: DatePlan, day: str = "dt", name: str = "split") -> DataFrame:
    """Label rows with their span; days in a gap get NULL."""
    label = F.lit(None).cast("string")
    for span, (low, high) in plan.spans().items():
        label = F.when(F.col(day).between(F.lit(low), F.lit(high)), F.lit(span)).otherwise(label)
    return df.withColumn(name, label)


def aligned_day(
    df: DataFrame, daily: DataFrame, end: dt.date, keys: Sequence[str] = (), label: str = "label", day: str = "dt"
) -> DataFrame:
    """Add ``_aligned``: the day moved so that the last labelled day of every series is ``end``.

    ``daily`` has the labelled days; one row per series joins the rows. NULL keys are a series.
    """
    if not keys:
        return df.withColumn("_aligned", F.col(day))
    last = daily.filter(F.col(label).isNotNull()).groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys])
    last = last.agg(F.datediff(F.lit(end), F.max(day)).alias("_early"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    moved = df.join(last, same).withColumn("_aligned", F.date_add(day, F.col("_early")))
    return moved.drop("_early", *[f"_of_{k}" for k in keys])


def split_frames(
    df: DataFrame, plan: DatePlan, features: Sequence[str], label: str, day: str = "dt"
) -> dict[str, DataFrame]:
    """One table per span with day, features and label; the day keeps x and y together.

    The input is read once and dealt to a folder per span.
    """
    rows = label_spans(df.select(day, *features, label), plan, day, "span_of")
    return stage_parts(rows, "span_of", list(plan.spans()), "spans")


def series_span(df: DataFrame, label: str = "label", day: str = "dt") -> tuple[dt.date, dt.date]:
    """(first day, last day with a label); a single row comes to the driver."""
    row = df.agg(F.min(day), F.max(F.when(F.col(label).isNotNull(), F.col(day)))).first()
    return row[0], row[1]


def tail_split(
    df: DataFrame,
    test_rows: int,
    gap_rows: int,
    targets: Sequence[str],
    day: str = "dt",
    keys: Sequence[str] = (),
    name: str = "split",
) -> DataFrame:
    """Last rows of every series are 'test', all before the gap 'train'; gap rows are dropped.

    Rows without one of the targets are dropped first.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    rows = df.na.drop("any", subset=list(targets)).withColumn("_back", F.row_number().over(w))
    label = F.when(F.col("_back") <= test_rows, F.lit("test")).when(
        F.col("_back") > test_rows + gap_rows, F.lit("train")
    )
    return rows.withColumn(name, label).filter(F.col(name).isNotNull()).drop("_back")


def last_rows(df: DataFrame, day: str = "dt", keys: Sequence[str] = ()) -> DataFrame:
    """The latest row of every series."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct("*"), day).alias("_row"))
    return picked.select("_row.*")


def keep_until(
    tables: dict[str, DataFrame], end: dt.date | str, days: dict[str, str]
) -> dict[str, DataFrame]:
    """Cut the named tables at an end day; the others pass through."""
    return {
        name: df.filter(F.col(days[name]) <= F.lit(str(end))) if name in days else df
        for name, df in tables.items()
    }
