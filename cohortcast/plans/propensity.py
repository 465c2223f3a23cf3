"""Propensity matching from raw rows to an evaluation and a training sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.operators.arms import ARMS
from cohortcast.operators.feature_rank import correlation_rank
from cohortcast.operators.frames import fill_means
from cohortcast.operators.learners import fit_propensity, propensity_scores
from cohortcast.operators.matching import (
    evaluation_sample,
    matched_training_sample,
    training_rows,
)
from cohortcast.session import stage


class MatchedSamples(NamedTuple):
    scores: DataFrame
    evaluation: DataFrame
    training: DataFrame


def matched_samples(
    df: DataFrame,
    features: Sequence[str],
    arms: Sequence[int] = ARMS,
    top_features: int = 40,
    cv: int = 3,
    keep: Sequence[str] = ("id", "userid", "treatment", "label", "rct_mark"),
    params: Mapping | None = None,
    evaluation_share: float = 0.5,
) -> MatchedSamples:
    """Rank features, fit propensities on observed rows, score all rows, draw and match.

    The evaluation sample takes at most ``evaluation_share`` of the observed controls. If its users
    leave no observed control to match with, that is an error.
    """
    filled = stage(fill_means(df, features), "filled")
    # the names of at most top_features columns
    chosen = [r["feature"] for r in correlation_rank(filled, features, top=top_features).collect()]
    observed = filled.filter(F.col("rct_mark") == 0)
    models = fit_propensity(observed, chosen, arms, cv=cv, params=params)
    scores = stage(propensity_scores(filled, models, chosen, keep), "scores")
    evaluation = evaluation_sample(scores, control_share=evaluation_share)
    rest = training_rows(scores, evaluation)
    if rest.filter("treatment = 0 and rct_mark = 0").isEmpty():
        raise ValueError("the evaluation sample leaves no observed control for matching")
    names = [f"ps_score_{a}" for a in arms]
    return MatchedSamples(scores, evaluation, matched_training_sample(rest, names))
