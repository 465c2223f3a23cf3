"""Uplift evaluation: fit, score every arm, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from cohortcast.operators.arms import ARMS, arms_long
from cohortcast.operators.curves import auuc, calibration
from cohortcast.operators.learners import fit_outcome, score_arms
from cohortcast.session import stage


class UpliftReport(NamedTuple):
    scored: DataFrame
    model_report: DataFrame
    auuc: DataFrame
    deciles: DataFrame


def evaluate_uplift(
    df: DataFrame,
    features: Sequence[str],
    arms: Sequence[int] = ARMS,
    treatment: str = "treatment",
    label: str = "label",
    id_col: str = "id",
    params: Mapping | None = None,
) -> UpliftReport:
    """Scores with the treatment as a feature, then AUUC and calibration of every arm.

    The scores are written once, because ranking reads its input several times.
    """
    inputs = [*features, treatment]
    model, report = fit_outcome(df, inputs, label, id_col, params=params)
    scored = stage(
        score_arms(model, df, inputs, arms, treatment, (id_col, treatment, label)), "scored"
    )
    long = arms_long(scored, arms, id_col)
    return UpliftReport(scored, report, auuc(long), calibration(long))
