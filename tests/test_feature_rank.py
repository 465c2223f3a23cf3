"""Batched Newton steps against the library's logistic fits, and tails against known values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortcast.operators import feature_rank


def test_likelihood_ratio_equals_single_fits(spark):
    rng = np.random.default_rng(12)
    n = 3000
    t, a, b = rng.integers(0, 2, n), rng.normal(size=n) * 1000 + 5e4, rng.integers(0, 3, n).astype(float)
    p = 1 / (1 + np.exp(-(-1 + 0.3 * t + 0.2 * b + 0.4 * t * (a - 5e4) / 1000)))
    frame = pd.DataFrame({"treatment": t, "a": a, "b": b, "c": 1.0, "label": (rng.random(n) < p).astype(int)})
    frame.loc[::7, "b"] = None
    df = spark.createDataFrame(frame).withColumn("b", F.nanvl("b", F.lit(None)))
    got = {r.feature: r for r in feature_rank.likelihood_ratio(df, ["a", "b", "c"]).collect()}
    for f in "ab":
        part = df.filter(F.col(f).isNotNull()).select(F.col("label").cast("double"), "treatment", f, (F.col("treatment") * F.col(f)).alias("tx"))
        losses = []
        for inputs in (["treatment", f], ["treatment", f, "tx"]):
            data = VectorAssembler(inputCols=inputs, outputCol="features").transform(part)
            losses.append(LogisticRegression(maxIter=200, tol=1e-12).fit(data).summary.objectiveHistory[-1])
        assert got[f].score == pytest.approx(2 * part.count() * (losses[0] - losses[1]), abs=1e-4)
        assert got[f].p_value == pytest.approx(math.erfc(math.sqrt(got[f].score / 2)))
    assert got["a"].place == 1 and got["a"].p_value < 1e-3
    assert got["c"].score == pytest.approx(0, abs=1e-6)  # a constant adds nothing


def test_f_tail():
    for score, freedom, want in ((4.964603, 10, 0.05), (10.044289, 10, 0.01), (3.841459, 1e9, 0.05), (0.0, 5, 1.0), (161.4476, 1, 0.05)):
        assert feature_rank.f_tail(score, freedom) == pytest.approx(want, rel=1e-4)
