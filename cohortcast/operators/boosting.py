"""Boosting round by round: losses of every prefix of trees, early stopping, own gradients.

A fitted tree is small and lies on the driver as arrays; rows are scored in Arrow batches, all trees at
once, so that the outputs of every prefix come from one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.operators.metrics import RECENT, recency_weighted_loss
from cohortcast.session import stage

# Fixed value: rounds without gain after which boosting ends.
PATIENCE = 20
CRITERIA: dict[str, Callable[[Column, Column], Column]] = {
    "squared": lambda y, p: (y - p) * (y - p),
    "relative": lambda y, p: F.try_divide(F.abs(y - p), F.abs(y)),
}


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays, the root first: value at most ``threshold`` goes left; leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node, all_ = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            goes_left = rows[all_, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.value[node]


def read_trees(text: str) -> tuple[list[float], list[Tree]]:
    """Weights and trees of a model's ``toDebugString``; a single tree has weight 1."""
    weights, trees, nodes, path = [], [], [], []

    def close() -> None:
        if nodes:
            columns = [np.array(c) for c in zip(*nodes, strict=True)]
            depth = max(len(p) for p in path)
            trees.append(Tree(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(float), depth))
        nodes.clear(), path.clear(), open_.clear()

    open_: list[int] = []  # nodes on the way down to the line that is read

    def hang(node: int) -> None:
        if open_:
            nodes[open_[-1]][3 if nodes[open_[-1]][5] else 2] = node

    for line in text.splitlines():
        head = re.match(r"\s*Tree \d+ \(weight (\S+)\):", line)
        split = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", line)
        leaf = re.match(r"\s*Predict: (\S+)", line)
        if head:
            close()
            weights.append(float(head[1]))
        elif split:
            hang(len(nodes))
            nodes.append([int(split[1]), float(split[2]), -1, -1, 0.0, False])
            open_.append(len(nodes) - 1)
        elif re.match(r"\s*Else \(", line):
            while nodes[open_[-1]][5]:  # both sides of what lies below are read
                open_.pop()
            nodes[open_[-1]][5] = True
        elif leaf:
            at = len(nodes)
            hang(at)
            nodes.append([0, 0.0, at, at, float(leaf[1]), False])
            path.append(tuple(open_))
    close()
    return weights or [1.0] * len(trees), trees


def tree_outputs(trees: Sequence[Tree], weights: Sequence[float], features: str = "features", start: float = 0.0) -> Column:
    """Array column: the sum of the weighted outputs of the first 1, 2, ... trees, and ``start``."""
    held = list(zip(weights, trees, strict=True))

    @F.pandas_udf("array<double>")
    def prefixes(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        matrix = np.stack(rows.to_numpy())
        each = np.stack([w * tree.predict(matrix) for w, tree in held], axis=1)
        return pd.Series(list(start + np.cumsum(each, axis=1)))

    return prefixes(vector_to_array(features))


def prefix_losses(df: DataFrame, prefixes: str, label: str = "label", criterion: str = "squared") -> DataFrame:
    """(iteration, loss): mean loss of every prefix, iterations from 1, in one aggregate.

    ``squared`` is the squared error, ``relative`` the absolute error over the absolute truth; rows
    whose loss is undefined (a missing truth, a zero one) don't count.
    """
    loss = CRITERIA[criterion]
    truth = F.col(label).cast("double")
    each = df.select(F.posexplode(F.transform(prefixes, lambda p: loss(truth, p))).alias("at", "loss"))
    return each.groupBy((F.col("at") + 1).alias("iteration")).agg(F.avg("loss").alias("loss"))


def best_iteration(losses: Sequence[float | None], patience: int | None = PATIENCE) -> tuple[int, int]:
    """(best, last): the first iteration with the least loss, and the one at which boosting ended.

    It ends when ``patience`` iterations in a row brought no smaller loss; None never ends it.
    """
    best, least = 1, float("inf")
    for at, loss in enumerate(losses, 1):
        if loss is not None and loss < least:
            best, least = at, loss
        elif patience is not None and at - best >= patience:
            return best, at
    return best, max(1, len(losses))


def best_prefix(df: DataFrame, prefixes: str, label: str = "label", criterion: str = "squared", patience: int | None = PATIENCE) -> DataFrame:
    """(iteration, loss, is_best, used): the losses with what early stopping makes of them.

    ``used`` iterations are those that boosting with ``patience`` would have made.
    """
    found = prefix_losses(df, prefixes, label, criterion)
    rows = {r["iteration"]: r["loss"] for r in found.collect()}  # one row per tree
    losses = [rows[k] for k in sorted(rows)]
    best, last = best_iteration(losses, patience)
    table = [(k, rows[k], k == best, k <= last) for k in sorted(rows)]
    return df.sparkSession.createDataFrame(table, "iteration int, loss double, is_best boolean, used boolean")


# ---- own gradients -----------------------------------------------------------------------------

Gradient = Callable[[DataFrame, str, str], tuple[Column, Column]]


def squared_gradient(df: DataFrame, label: str, margin: str) -> tuple[Column, Column]:
    return -2.0 * (F.col(label) - F.col(margin)), F.lit(2.0)


def recency_gradient(age: str = "age", recent: int = RECENT) -> Gradient:
    """Gradient and curvature of the recency-weighted squared error (see ``recency_weighted_loss``).

    The weight of recent rows depends on all of them; it comes from one aggregate per round and is
    a constant within it.
    """

    def gradient(df: DataFrame, label: str, margin: str) -> tuple[Column, Column]:
        weight = F.lit(recency_weighted_loss(df, margin, label, age, recent).first()["weight"])
        factor = F.when(F.col(age) <= recent, weight).otherwise(F.lit(1.0))
        return -2.0 * factor * (F.col(label) - F.col(margin)), 2.0 * factor

    return gradient


@dataclass
class Boosted:
    """Trees that were added to ``start``, each times ``step``; losses per round on the held rows."""

    start: float
    step: float
    trees: list[Tree]
    losses: list[float]
    best: int

    def prefixes(self, features: str = "features") -> Column:
        """Predictions after 1, 2, ... rounds."""
        return tree_outputs(self.trees, [self.step] * len(self.trees), features, self.start)

    def prediction(self, features: str = "features") -> Column:
        """Prediction of the best iteration."""
        kept = self.trees[: self.best]
        return F.element_at(tree_outputs(kept, [self.step] * len(kept), features, self.start), -1)


def newton_boost(
    train: DataFrame,
    valid: DataFrame,
    gradient: Gradient,
    loss: Callable[[DataFrame, str, str], float],
    label: str = "label",
    rounds: int = 130,
    step: float = 0.05,
    depth: int = 10,
    patience: int | None = PATIENCE,
    seed: int = 7,
    stage_every: int = 5,
) -> Boosted:
    """Boosting with a given gradient: one weighted regression tree per round over the margins.

    A tree is fitted to -gradient / curvature with the curvature as weight, so that a leaf's value is
    its Newton step. ``train`` and ``valid`` have features, label and what the functions need. After
    ``patience`` rounds without a smaller ``loss`` of the valid rows no more trees are fitted. Margins
    are columns of the rows and are written every few rounds, which keeps plans short.
    """
    start = train.agg(F.avg(label)).first()[0] or 0.0
    sides = [side.filter(F.col(label).isNotNull()).withColumn("_margin", F.lit(float(start))) for side in (train, valid)]
    fitter = DecisionTreeRegressor(maxDepth=depth, labelCol="_target", weightCol="_curve", seed=seed)
    out = Boosted(float(start), step, [], [], 1)
    for at in range(1, rounds + 1):
        rows = sides[0]
        slope, curve = gradient(rows, label, "_margin")
        fitting = rows.withColumns({"_curve": curve, "_slope": slope}).filter("_curve > 0")
        fitting = fitting.withColumn("_target", -F.col("_slope") / F.col("_curve"))
        model = fitter.fit(fitting.select("features", "_target", "_curve"))
        tree = read_trees(model.toDebugString)[1][0]
        out.trees.append(tree)
        add = F.element_at(tree_outputs([tree], [step]), -1)
        sides = [side.withColumn("_margin", F.col("_margin") + add) for side in sides]
        if at % stage_every == 0:
            sides = [stage(side, "margins") for side in sides]
        out.losses.append(float(loss(sides[1], label, "_margin")))
        out.best, last = best_iteration(out.losses, patience)
        if patience is not None and last - out.best >= patience:
            break
    return out


def recency_boost(train: DataFrame, valid: DataFrame, age: str = "age", recent: int = RECENT, **settings) -> Boosted:
    """Boosting on the recency-weighted squared error, judged by it on the valid rows."""

    def loss(df: DataFrame, label: str, margin: str) -> float:
        return recency_weighted_loss(df, margin, label, age, recent).first()["loss"]

    return newton_boost(train, valid, recency_gradient(age, recent), loss, **settings)

