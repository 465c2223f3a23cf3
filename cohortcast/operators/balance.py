"""Balance of a representation between treated and control rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.scalars import squared_distance
from cohortcast.operators.frames import one_row
from cohortcast.operators.metrics import log_loss_of_logit
from cohortcast.operators.ordering import lay_out_hashed

# Sinkhorn steps, regularisation and treated share of the transport distance.
STEPS, LAMBDA, SHARE = 10, 1.0, 0.5
BATCH_ROWS = 200


def mean_distance(df: DataFrame, x: str = "x", treatment: str = "t", factor: float = 1.0) -> DataFrame:
    """One row: distance of the treated and control mean vectors times ``factor``.

    NULL if a side is empty. One aggregate over vectors, combined before the shuffle.
    """
    side = (F.col(treatment) > 0).cast("int").alias("side")
    vectors = df.select(side, array_to_vector(F.col(x).cast("array<double>")).alias("v"))
    means = vectors.groupBy("side").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))
    sides = means.agg(
        F.max(F.when(F.col("side") == 1, F.col("mean"))).alias("a"),
        F.max(F.when(F.col("side") == 0, F.col("mean"))).alias("b"),
    )
    distance = F.sqrt(squared_distance("a", "b")) * F.lit(float(factor))
    return sides.select(distance.alias("distance"))


def mmd(df: DataFrame, x: str = "x", treatment: str = "t") -> DataFrame:
    """Twice the distance of the group means."""
    return mean_distance(df, x, treatment, 2.0)


def transport_distance(treated: np.ndarray, control: np.ndarray) -> float:
    """Twice the entropic transport cost between two small sets of vectors."""
    n_t, n_c = len(treated), len(control)
    if n_t == 0 or n_c == 0:
        return 0.0
    cost = ((treated[:, None, :] - control[None, :, :]) ** 2).sum(axis=2)
    logs = -LAMBDA * cost
    kernel = np.exp(logs - logs.max(axis=1, keepdims=True))
    a, b = SHARE / n_t, (1 - SHARE) / n_c
    u = np.full(n_t, a)
    for _ in range(STEPS):
        u = a / (kernel @ (b / (kernel.T @ u)))
    v = b / (kernel.T @ u)
    return float(2 * (u[:, None] * v[None, :] * kernel * cost).sum())


def batch_transport(
    df: DataFrame,
    x: str = "x",
    treatment: str = "t",
    id_col: str = "id",
    batch_rows: int = BATCH_ROWS,
    seed: int = 0,
) -> DataFrame:
    """Transport distance per batch: (batch, n_treated, n_control, distance).

    As in mini-batch training the pairs are those of one batch. Batches are consecutive rows of a
    hash order, so none has more than ``batch_rows`` rows.
    """
    ranked = lay_out_hashed(df.select(id_col, x, treatment), id_col, seed).running()
    batches = ranked.select(
        F.floor((F.col("k") - 1) / batch_rows).cast("long").alias("batch"),
        (F.col(treatment) > 0).cast("int").alias("side"),
        F.col(x).cast("array<double>").alias("x"),
    )

    def distance(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(rows["x"].to_numpy())
        side = rows["side"].to_numpy() == 1
        return pd.DataFrame(
            {
                "batch": [rows["batch"].iloc[0]],
                "n_treated": [int(side.sum())],
                "n_control": [int((~side).sum())],
                "distance": [transport_distance(vectors[side], vectors[~side])],
            }
        )

    return batches.groupBy("batch").applyInPandas(
        distance, "batch long, n_treated long, n_control long, distance double"
    )


def balanced_loss(
    df: DataFrame,
    logit: str,
    y: str,
    x: str = "x",
    treatment: str = "t",
    use_ipm: bool = False,
    ipm: str | None = None,
    id_col: str = "id",
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """One row: prediction loss, balance term and their sum.

    ``ipm`` is ``mmd`` or ``wasserstein``; the latter is the mean over batches.
    """
    if use_ipm and ipm not in ("mmd", "wasserstein"):
        raise ValueError(f"unknown balance term: {ipm}")
    loss = df.agg(F.avg(log_loss_of_logit(logit, y)).alias("pred_loss"))
    if not use_ipm:
        term = df.sparkSession.range(1).select(F.lit(0.0).alias("ipm_loss"))
    elif ipm == "mmd":
        term = mmd(df, x, treatment).select(F.col("distance").alias("ipm_loss"))
    else:
        term = batch_transport(df, x, treatment, id_col, batch_rows).agg(
            F.avg("distance").alias("ipm_loss")
        )
    both = one_row([loss, term])
    return both.withColumn("total_loss", F.col("pred_loss") + F.col("ipm_loss"))
