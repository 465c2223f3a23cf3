"""Daily sales forecast: features per horizon, one model per horizon, one result table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.dates import SPRING_FESTIVAL
from cohortcast.operators.frames import one_row, unite
from cohortcast.operators.learners import assemble, fit_best, refit
from cohortcast.operators.metrics import percentage_errors, weighted_error
from cohortcast.operators.series import add_future_labels, daily_sum, features_from_daily
from cohortcast.operators.splits import DatePlan, aligned_day, label_spans, last_rows, series_span, tail_split
from cohortcast.session import in_parallel, stage

VALID_DAYS = 300
HORIZONS = tuple(range(1, 15))


def horizon_features(
    daily: DataFrame,
    horizon: int,
    keys: Sequence[str],
    calendar: Mapping[int, dt.date],
    counts: DataFrame | None,
) -> tuple[DataFrame, list[str]]:
    """Feature table of one horizon and the names of its features."""
    rows = features_from_daily(daily, horizon, keys, calendar)
    if counts is not None:
        rows = rows.join(counts, "dt", "left")
    features = [c for c in rows.columns if c not in (*keys, "dt", "label", "label_smooth")]
    return rows, features


def horizon_forecast(
    sales: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    valid_days: int = VALID_DAYS,
    day: str = "ancestor_order_create_dt",
    value: str = "pay_gmv_d1",
    keys: Sequence[str] = (),
    calendar: Mapping[int, dt.date] = SPRING_FESTIVAL,
    counts: DataFrame | None = None,
    params: Mapping | None = None,
    gap: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(forecast, test errors): one model per horizon.

    The spans of every series lie before its own last day, so a series that ends early gets its
    whole forecast too. ``gap`` keeps a horizon's days free between the spans.

    The forecast keeps the last day of every horizon: (keys, horizon, dt, y_pred). The errors cover
    the test spans: (keys, horizon, dt, label, y_pred, pe, nex_n_day). The raw rows are read once;
    everything later works on daily totals. ``counts`` adds one row per day of further features.
    """
    daily = stage(daily_sum(sales, day, value, keys), "daily")
    start, end = series_span(daily)

    def run(horizon: int):
        def job() -> tuple[DataFrame, DataFrame]:
            rows, features = horizon_features(daily, horizon, keys, calendar, counts)
            plan = DatePlan(start, end, horizon, valid_days, product=True, gap=gap)
            rows = label_spans(aligned_day(rows, daily, end, keys), plan, "_aligned")
            rows = assemble(rows, features).select(
                *keys, "dt", "label", "split", "features"
            )
            rows = stage(rows.filter("split is not null"), f"horizon{horizon}")
            labelled = rows.filter("label is not null")
            train, valid = (labelled.filter(F.col("split") == s) for s in ("train", "valid"))
            _, best = fit_best(train, valid, params)
            model = refit(train.unionByName(valid), best, params)
            scored = model.transform(rows.filter("split in ('test', 'predict')")).select(
                *keys, "dt", "label", "split", F.col("prediction").alias("y_pred"),
                F.lit(horizon).alias("horizon"),
            )
            ahead = last_rows(scored.filter("split = 'predict'"), keys=keys)
            tested = percentage_errors(scored.filter("split = 'test'"), keys=keys)
            return ahead.select(*keys, "horizon", "dt", "y_pred"), tested.select(
                *keys, "horizon", "dt", "label", "y_pred", "pe", "nex_n_day"
            )

        return job

    parts = in_parallel(sales.sparkSession, [run(h) for h in horizons])
    return unite([p[0] for p in parts]), unite([p[1] for p in parts])


def direct_forecast(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    target: str = "label",
    day: str = "dt",
    keys: Sequence[str] = (),
    valid_rows: int = 150,
    gap_rows: int = 0,
    test_rows: int = 30,
    retrain_to_test: bool = False,
    retrain_to_final: bool = False,
    version: str = "",
    params: Mapping | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(forecast, report) with one model per day ahead, trained directly on the later labels.

    Tail rows of a series are the test set, the tail of the rest the validation set. The report has
    the weighted error per part: (step, best_iteration, version, train_mape, valid_mape, test_mape).
    """
    labels = [f"y{i}_real" for i in range(1, length + 1)]
    rows = add_future_labels(df, length, target, day, "y", keys)
    rows = stage(assemble(rows, features).select(*keys, day, *labels, "features"), "direct")
    # read by every step and part
    outer = stage(tail_split(rows, test_rows, length, labels, day, keys), "direct_outer")
    inner = stage(
        tail_split(outer.filter("split = 'train'").drop("split"), valid_rows, gap_rows, labels, day, keys), "direct_inner"
    )
    train, valid = (inner.filter(F.col("split") == s) for s in ("train", "test"))
    train_all, test = (outer.filter(F.col("split") == s) for s in ("train", "test"))

    def run(step: int):
        def job() -> tuple[DataFrame, DataFrame]:
            def part(table: DataFrame) -> DataFrame:
                return table.select(F.col(f"y{step}_real").alias("label"), "features")

            _, best = fit_best(part(train), part(valid), params)
            model = refit(part(train), best, params)
            tester = refit(part(train_all), best, params) if retrain_to_test else model
            final = refit(part(rows).na.drop(subset=["label"]), best, params) if retrain_to_final else tester

            def error(fitted, table: DataFrame, name: str) -> DataFrame:
                scored = fitted.transform(part(table))
                return weighted_error(scored, "prediction").withColumnRenamed("mape", name)

            parts = (("train_mape", model, train), ("valid_mape", model, valid), ("test_mape", tester, test))
            report = one_row([error(fitted, table, name) for name, fitted, table in parts])
            report = report.select(
                F.lit(step).alias("step"), F.lit(best).alias("best_iteration"),
                F.lit(version).alias("version"), "train_mape", "valid_mape", "test_mape",
            )
            latest = last_rows(rows.select(*keys, day, "features"), day, keys)
            ahead = final.transform(latest).select(
                *keys, F.lit(step).alias("step"),
                F.date_add(day, step).alias(day), F.col("prediction").alias("y_pred"),
            )
            return ahead, report

        return job

    parts = in_parallel(df.sparkSession, [run(i) for i in range(1, length + 1)])
    return unite([p[0] for p in parts]), unite([p[1] for p in parts])
