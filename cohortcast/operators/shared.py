"""One model for all arms: a shared layer over the features and a head per arm.

Every step is one pass: tasks add up the gradients of their rows in Arrow batches, each row through the
head of its own arm, and the driver moves the weights, whose number depends on features, width and
arms only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.session import stage

WIDTH, STEPS, RATE = 16, 40, 0.05
BLOCK = 2048


@dataclass
class Weights:
    """``layer`` (width, features + 1) with the bias last, ``heads`` (arms, width + 1) likewise."""

    layer: np.ndarray
    heads: np.ndarray

    @classmethod
    def random(cls, features: int, arms: int, width: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        layer = rng.standard_normal((width, features + 1)) / np.sqrt(features + 1)
        return cls(layer, rng.standard_normal((arms, width + 1)) * 0.1)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.layer[:, :-1].T + self.layer[:, -1])

    def outcomes(self, x: np.ndarray) -> np.ndarray:
        """Probability of the outcome under every arm: (rows, arms)."""
        return 1 / (1 + np.exp(-(self.hidden(x) @ self.heads[:, :-1].T + self.heads[:, -1])))


def gradients(weights: Weights, x: np.ndarray, arm: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed log loss of the rows' own heads, and its gradients by layer and heads."""
    # rows last; a row's own head is picked by a matrix of heads by rows, so that all is matrix products
    x, each = x.T, np.arange(len(x))
    layer, heads = weights.layer[:, :-1], weights.heads[:, :-1]
    hidden = layer @ x
    hidden += weights.layer[:, -1:]
    np.tanh(hidden, out=hidden)
    score = (heads @ hidden)[arm, each] + weights.heads[arm, -1]
    small = np.exp(-np.abs(score))
    loss = float((np.maximum(score, 0) + np.log1p(small) - y * score).sum())
    rest = np.zeros((len(heads), len(each)))
    rest[arm, each] = np.where(score >= 0, 1.0, small) / (1 + small) - y
    d_heads = np.column_stack([rest @ hidden.T, rest.sum(axis=1)])
    hidden *= hidden
    np.subtract(1.0, hidden, out=hidden)
    hidden *= heads.T @ rest
    return loss, np.column_stack([hidden @ x.T, hidden.sum(axis=1)]), d_heads


@dataclass
class SharedModel:
    features: list[str]
    arms: list[int]
    centre: np.ndarray
    scale: np.ndarray
    weights: Weights
    losses: list[float]

    def inputs(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Standardised features; a missing one is at its mean."""
        x = (np.stack(columns, axis=1) - self.centre) / self.scale
        return np.where(np.isfinite(x), x, 0.0)


def fit_shared(
    df: DataFrame,
    features: Sequence[str],
    arms: Sequence[int],
    treatment: str = "treatment",
    label: str = "label",
    width: int = WIDTH,
    steps: int = STEPS,
    rate: float = RATE,
    seed: int = 7,
) -> SharedModel:
    """Fit on the rows of the given arms (0 is control); rows without label don't count.

    Adam on the full gradient; the losses are mean log losses before each step.
    """
    features, arms = list(features), list(arms)
    number = F.array_position(F.lit(arms), F.col(treatment)).cast("int") - 1
    rows = df.filter(F.col(treatment).isin(arms) & F.col(label).isNotNull()).select(
        number.alias("_arm"), F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    )
    rows = stage(rows, "shared")
    shape = rows.agg(F.count(F.lit(1)), *[g(f"x{i}") for i in range(len(features)) for g in (F.avg, F.stddev_pop)]).first()
    count = max(1, shape[0])
    centre = np.array([shape[1 + 2 * i] or 0.0 for i in range(len(features))])
    scale = np.array([shape[2 + 2 * i] or 1.0 for i in range(len(features))])
    model = SharedModel(features, arms, centre, scale, Weights.random(len(features), len(arms), width, seed), [])
    # as ``SharedModel.inputs``, but once per row and step in Spark's own code
    standard = [(F.col(f"x{i}") - F.lit(float(c))) / F.lit(float(s)) for i, (c, s) in enumerate(zip(centre, scale, strict=True))]
    finite = [F.when(F.abs(v) < F.lit(float("inf")), v).otherwise(0.0).alias(f"x{i}") for i, v in enumerate(standard)]
    rows = rows.select("_arm", "_y", *finite)

    def step(weights: Weights):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, layer, heads = 0.0, np.zeros_like(weights.layer), np.zeros_like(weights.heads)
            for batch in batches:
                arm, y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = np.stack(columns).T
                for at in range(0, len(y), BLOCK):
                    part = slice(at, at + BLOCK)
                    some = gradients(weights, x[part], arm[part], y[part])
                    loss, layer, heads = loss + some[0], layer + some[1], heads + some[2]
            flat = np.concatenate([[loss], layer.ravel(), heads.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

        return run

    flat = np.concatenate([model.weights.layer.ravel(), model.weights.heads.ravel()])
    first, second, cut = np.zeros_like(flat), np.zeros_like(flat), model.weights.layer.size
    for k in range(1, steps + 1):
        sums = rows.mapInArrow(step(model.weights), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(len(flat) + 1)
        for r in sums:
            total[r["at"]] = r["v"]
        model.losses.append(total[0] / count)
        slope = total[1:] / count
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        flat = flat - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        model.weights = Weights(flat[:cut].reshape(model.weights.layer.shape), flat[cut:].reshape(model.weights.heads.shape))
    return model


def predict_shared(model: SharedModel, df: DataFrame, keep: Sequence[str] = ("id", "treatment", "label")) -> DataFrame:
    """The kept columns and the predicted outcome ``p_{arm}`` under every arm, for all rows."""

    @F.pandas_udf("array<double>")
    def outcomes(columns: pd.DataFrame) -> pd.Series:
        x = model.inputs([columns[c].to_numpy(dtype=float) for c in columns])
        return pd.Series(list(model.weights.outcomes(x)))

    x = F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)])
    scored = df.select(*keep, outcomes(x).alias("_p"))
    return scored.select(*keep, *[F.col("_p")[i].alias(f"p_{a}") for i, a in enumerate(model.arms)])
