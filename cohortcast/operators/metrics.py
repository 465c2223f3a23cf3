"""Errors of classifications and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.hashing import as_column
from cohortcast.functions.scalars import growth_weight, over_threshold
from cohortcast.operators.frames import one_row
from cohortcast.operators.ordering import ROWS_PER_BUCKET, lay_out

# Rows counted as recent by the weighted loss; smallest probability in a log.
RECENT, TINY = 150, 1e-15


def log_loss(p: str | Column, y: str | Column) -> Column:
    """Log loss of one row's probability."""
    q = F.least(F.greatest(as_column(p), F.lit(TINY)), F.lit(1.0 - TINY))
    target = as_column(y)
    return -(target * F.log(q) + (F.lit(1.0) - target) * F.log(F.lit(1.0) - q))


def log_loss_of_logit(logit: str | Column, y: str | Column) -> Column:
    """Log loss of one row's logit, without overflow."""
    z = as_column(logit)
    return F.greatest(z, F.lit(0.0)) - z * as_column(y) + F.log1p(F.exp(-F.abs(z)))


def roc_auc(df: DataFrame, p: str = "p", y: str = "y", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row with the exact area under the ROC curve; ties count half.

    Rows are counted per score first; the running count over scores uses the bucketed order.
    """
    per_score = df.groupBy(F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"),
    )
    layout = lay_out(per_score, "score", "score", (), False, rows_per_bucket)
    running = layout.running(upto=F.col("neg"))
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return running.agg(F.try_divide(wins, pairs).alias("auc"))


def classification_report(
    df: DataFrame, p: str = "p", y: str = "y", threshold: float = 0.5
) -> DataFrame:
    """One row: rows, mean log loss, accuracy at the threshold, area under the ROC curve."""
    plain = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(log_loss(p, y)).alias("logloss"),
        F.avg((over_threshold(p, threshold) == F.col(y)).cast("int")).alias("accuracy"),
    )
    return one_row([plain, roc_auc(df, p, y)])


def treatment_head_loss(df: DataFrame, p: str = "p_t", treatment: str = "t") -> DataFrame:
    """One row: the summed squared error of a treatment probability."""
    return df.agg(F.sum((F.col(p) - F.col(treatment)) ** 2).alias("t_loss"))


def percentage_errors(
    df: DataFrame,
    predicted: str = "y_pred",
    truth: str = "label",
    day: str = "dt",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the relative error ``pe`` and the day number ``nex_n_day`` within the forecast span."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumns(
        {
            "pe": F.try_divide(F.col(predicted) - F.col(truth), F.col(truth)),
            "nex_n_day": F.row_number().over(w),
        }
    )


def forecast_errors(forecast: DataFrame, truth: DataFrame, on: Sequence[str] = ("dt",)) -> DataFrame:
    """Mean and mean absolute relative error of a forecast joined with the truth.

    ``forecast`` has ``y_pred``, ``truth`` has ``label``; days without either are left out.
    """
    both = forecast.join(truth, list(on)).na.drop("any")
    return mean_errors(both.withColumn("pe", F.try_divide(F.col("y_pred") - F.col("label"), F.col("label"))))


def mean_errors(errors: DataFrame, pe: str = "pe") -> DataFrame:
    """One row: mean and mean absolute value of a relative error."""
    return errors.agg(F.avg(pe).alias("pe_mean"), F.avg(F.abs(F.col(pe))).alias("ape_mean"))


def weighted_error(
    df: DataFrame, predicted: str = "y_pred", truth: str = "label", groups: Sequence[str] = ()
) -> DataFrame:
    """(groups, mape): summed absolute error over the summed truth, three digits."""
    ratio = F.try_divide(F.sum(F.abs(F.col(predicted) - F.col(truth))), F.sum(truth))
    return df.groupBy(*groups).agg(F.round(ratio, 3).alias("mape"))


def recency_weighted_loss(
    df: DataFrame,
    predicted: str = "y_pred",
    truth: str = "label",
    age: str = "age",
    recent: int = RECENT,
) -> DataFrame:
    """One row: squared error in which recent rows weigh more, the more one-sided their error is.

    Sums for recent and other rows come from one aggregate; the weight is applied to the sums.
    """
    residual = F.col(truth) - F.col(predicted)
    near = F.col(age) <= recent
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(near, residual)), F.lit(0.0)).alias("bias"),
        F.coalesce(F.sum(F.when(near, F.abs(residual))), F.lit(0.0)).alias("size"),
        F.coalesce(F.sum(F.when(near, residual * residual)), F.lit(0.0)).alias("near_sq"),
        F.coalesce(F.sum(F.when(~near, residual * residual)), F.lit(0.0)).alias("far_sq"),
    )
    share = F.abs(F.col("bias")) / F.greatest(F.lit(1.0), F.col("size"))
    rows = sums.withColumn("weight", growth_weight(share))
    loss = F.try_divide(F.col("near_sq") * F.col("weight") + F.col("far_sq"), F.col("n"))
    return rows.select("weight", loss.alias("loss"))
