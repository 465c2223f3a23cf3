"""Prefix losses, early stopping and Newton boosting against the library and plain numpy."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cohortcast.operators import boosting, learners, metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)).round(3)
    y = np.where(x[:, 0] > 0.2, 30.0, 10.0) + 5 * x[:, 1] + rng.normal(size=400)
    data = [(Vectors.dense(v), float(t), i % 300, i % 4 == 0) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))]
    return spark.createDataFrame(data, ["features", "label", "age", "held"])


def test_prefixes_equal_the_library(rows):
    train, valid = rows.filter("not held"), rows.filter("held")
    model = GBTRegressor(maxIter=12, maxDepth=4, stepSize=0.3, seed=3).fit(train)
    weights, trees = boosting.read_trees(model.toDebugString)
    assert len(trees) == 12 and weights == list(model.treeWeights)
    scored = model.transform(valid).withColumn("prefixes", boosting.tree_outputs(trees, weights))
    for r in scored.collect():
        assert r.prefixes[-1] == pytest.approx(r.prediction, abs=1e-9)
    losses = {r.iteration: r.loss for r in boosting.prefix_losses(scored, "prefixes").collect()}
    assert [losses[k] for k in range(1, 13)] == pytest.approx(model.evaluateEachIteration(valid, "squared"))


@pytest.mark.parametrize("losses, patience, want", [
    ([5, 4, 3, 4, 5, 1], 2, (3, 5)), ([5, 4, 3, 4, 5, 1], 3, (6, 6)), ([5, 4, 3, 4, 5, 1], None, (6, 6)),
    ([2, 2, 2], 20, (1, 3)), ([None, 3.0], 1, (2, 2)), ([], 20, (1, 1)), ([1.0], 20, (1, 1)),
])
def test_early_stopping(losses, patience, want):
    assert boosting.best_iteration(losses, patience) == want


def test_relative_criterion_leaves_out_zero_truth(spark):
    df = spark.createDataFrame([(10.0, [8.0, 10.0]), (0.0, [1.0, 1.0]), (None, [1.0, 2.0]), (-4.0, [-2.0, -3.0])], "label double, p array<double>")
    got = {r.iteration: r.loss for r in boosting.prefix_losses(df, "p", criterion="relative").collect()}
    assert got == {1: pytest.approx((0.2 + 0.5) / 2), 2: pytest.approx((0.0 + 0.25) / 2)}


def test_best_iteration_of_a_fit(rows):
    train, valid = rows.filter("not held"), rows.filter("held")
    _, best = learners.fit_best(train, valid, {"maxIter": 8, "maxDepth": 3, "stepSize": 0.9}, "squared", None)
    model, _ = learners.fit_best(train, valid, {"maxIter": 8, "maxDepth": 3, "stepSize": 0.9}, "squared", None)
    losses = model.evaluateEachIteration(valid, "squared")
    assert best == losses.index(min(losses)) + 1


def test_newton_step_of_a_stump(spark):
    """One round of depth 1: leaves are minus the summed gradient over the summed curvature."""
    data = [(Vectors.dense([float(i >= 5)]), float(10 * (i >= 5) + i), i) for i in range(10)]
    df = spark.createDataFrame(data, ["features", "label", "age"])
    fitted = boosting.recency_boost(df, df, recent=3, rounds=1, step=1.0, depth=1)
    y = np.array([r[1] for r in data])
    weight = metrics.recency_weighted_loss(df.withColumn("y_pred", F.lit(float(y.mean()))), recent=3).first().weight
    w = np.where(np.arange(10) <= 3, weight, 1.0)
    for half in (slice(0, 5), slice(5, 10)):
        step = (w[half] * (y[half] - y.mean())).sum() / w[half].sum()
        got = df.filter(f"age >= {half.start} and age < {half.stop}").select(fitted.prediction().alias("p")).first().p
        assert got == pytest.approx(y.mean() + step)


def test_loss_falls_and_equals_sql(rows):
    train, valid = rows.filter("not held"), rows.filter("held")
    fitted = boosting.recency_boost(train, train, rounds=8, step=0.4, depth=3, stage_every=3)
    assert all(b < a for a, b in zip(fitted.losses, fitted.losses[1:])) and fitted.best == 8
    scored = train.select("label", "age", fitted.prediction().alias("y_pred")).toPandas()
    sql = """WITH res AS (SELECT label - y_pred AS e, age <= 150 AS near FROM scored),
    weight AS (SELECT 10 / (1 + EXP(-2 * ABS(SUM(e) FILTER (near)) / GREATEST(1, SUM(ABS(e)) FILTER (near)))) + 1 - 5 AS w FROM res)
    SELECT AVG(CASE WHEN near THEN e * e * w ELSE e * e END) FROM res, weight"""
    assert duckdb.sql(sql).fetchall()[0][0] == pytest.approx(fitted.losses[-1])
    few = boosting.recency_boost(train, valid, rounds=60, step=1.0, depth=6, patience=3)
    assert len(few.trees) < 60 and len(few.losses) - few.best == 3
