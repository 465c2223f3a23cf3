"""Daily batch: read one day, run a pandas step, replace the result's partitions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import SparkSession

from cohortcast.functions.dates import run_dates
from cohortcast.sources.tables import map_batches, overwrite_days, read_day


def run_day(
    spark: SparkSession,
    source: str,
    target: str,
    columns: Sequence[str],
    step: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    run_date: dt.date | None = None,
    partitions: int | None = None,
) -> str:
    """Process the day before the run date and return it; a rerun replaces the same partition."""
    _, yesterday = run_dates(run_date)
    rows = read_day(spark, source, yesterday, columns)
    overwrite_days(map_batches(rows, step, schema, partitions), target)
    return yesterday
