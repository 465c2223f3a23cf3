"""The shared-layer model: gradients, learning, routing to heads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from cohortcast.operators import shared


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    weights = shared.Weights.random(3, 4, 5, 2)
    x, arm, y = rng.normal(size=(30, 3)), rng.integers(0, 4, 30), rng.integers(0, 2, 30).astype(float)
    loss, layer, heads = shared.gradients(weights, x, arm, y)
    p = weights.outcomes(x)[np.arange(30), arm]
    assert loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    for matrix, slope in ((weights.layer, layer), (weights.heads, heads)):
        for at in np.ndindex(matrix.shape):
            held, losses = matrix[at], []
            for move in (1e-5, -1e-5):
                matrix[at] = held + move
                losses.append(shared.gradients(weights, x, arm, y)[0])
            matrix[at] = held
            assert slope[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-4)


def test_learns_each_arm(spark):
    rng = np.random.default_rng(4)
    n = 4000
    a, t = rng.normal(size=n) * 50 + 10, rng.choice([0, 3, 9], n)
    chance = np.where(t == 0, 0.2, np.where(t == 3, np.where(a > 10, 0.9, 0.2), np.where(a > 10, 0.2, 0.9)))
    frame = pd.DataFrame({"id": np.arange(n), "a": a, "b": 1.0, "treatment": t, "label": (rng.random(n) < chance).astype(float)})
    frame.loc[::50, "a"] = None
    df = spark.createDataFrame(frame)
    model = shared.fit_shared(df, ["a", "b"], [0, 3, 9], steps=60, rate=0.1)
    assert model.losses[-1] < 0.55 < model.losses[0]
    rows = shared.predict_shared(model, df).toPandas()
    assert len(rows) == n and ((rows[["p_0", "p_3", "p_9"]] > 0) & (rows[["p_0", "p_3", "p_9"]] < 1)).all().all()
    high = a > 30
    assert rows.p_3[high].mean() > 0.7 > 0.4 > rows.p_9[high].mean()


def test_gradients_are_matrix_products():
    """Rows times heads: no step of numpy's slow scattered additions, far scores stay finite."""
    rng = np.random.default_rng(5)
    weights = shared.Weights.random(4, 3, 6, 1)
    weights.heads[:, -1] = [800.0, -800.0, 0.0]
    x, arm, y = rng.normal(size=(500, 4)), rng.integers(0, 3, 500), rng.integers(0, 2, 500).astype(float)
    with np.errstate(all="raise", under="ignore"):
        loss, layer, heads = shared.gradients(weights, x, arm, y)
    assert np.isfinite(loss) and np.isfinite(layer).all() and np.isfinite(heads).all()
    parts = [shared.gradients(weights, x[arm == k], arm[arm == k], y[arm == k]) for k in range(3)]
    assert layer == pytest.approx(sum(p[1] for p in parts))
    assert heads == pytest.approx(sum(p[2] for p in parts))
    assert loss == pytest.approx(sum(p[0] for p in parts))
