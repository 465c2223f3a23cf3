"""Rank features by their relation to the treatment or to its effect."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.hashing import hash01
from cohortcast.operators.ordering import exact_quantiles
from cohortcast.session import stage

# Fixed value: smallest probability a divergence is computed with.
EPSILON = 1e-6


def _long(df: DataFrame, features: Sequence[str], keep: Sequence[str], make) -> DataFrame:
    """One row per feature from expressions over a wide row; no shuffle."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *make(f)) for f in features])
    return df.select(*keep, F.inline(rows))


def correlation_rank(
    df: DataFrame,
    features: Sequence[str],
    treatment: str = "treatment",
    id_col: str = "id",
    repeats: int = 3,
    fraction: float = 0.66,
    top: int | None = None,
) -> DataFrame:
    """(feature, score, place): mean absolute correlation with the treatment over hash samples.

    All samples and features are one aggregate over the table.
    """
    # hashed once per row and sample, not once per feature
    rows = df.select(
        treatment, *features,
        *[(hash01(id_col, i) < F.lit(float(fraction))).alias(f"_drawn_{i}") for i in range(repeats)],
    )
    aggs = []
    for i in range(repeats):
        t = F.when(F.col(f"_drawn_{i}"), F.col(treatment))
        for f in features:
            pair = F.corr(F.when(t.isNotNull(), F.col(f).cast("double")), t)
            aggs.append(F.abs(F.nanvl(pair, F.lit(None))).alias(f"{f}__{i}"))
    wide = rows.agg(*aggs)

    def scores(f: str) -> list[Column]:
        parts = [F.col(f"{f}__{i}") for i in range(repeats)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return [(total / repeats).alias("score")]

    # one row per feature from here on
    ranked = _long(wide, features, [], scores)
    order = Window.orderBy(F.desc_nulls_last("score"), "feature")
    ranked = ranked.withColumn("place", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("place") <= top)


def interaction_f(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    group: str = "treatment",
    control: int = 0,
    treated: int = 1,
) -> DataFrame:
    """(feature, score, freedom, p_value, place): F statistic of the feature-by-treatment term in a linear model.

    Both arms' slopes and residuals come from sums of one aggregate; ``p_value`` is the tail of the F
    distribution with 1 and ``freedom`` degrees.
    """
    rows = df.filter(F.col(group).isin(control, treated))
    aggs = []
    for f in features:
        for side, arm in (("t", treated), ("c", control)):
            here = (F.col(group) == arm) & F.col(f).isNotNull() & F.col(label).isNotNull()
            x = F.when(here, F.col(f).cast("double"))
            y = F.when(here, F.col(label).cast("double"))
            aggs += [
                F.count(x).alias(f"{f}__n_{side}"),
                F.regr_sxx(y, x).alias(f"{f}__xx_{side}"),
                F.regr_syy(y, x).alias(f"{f}__yy_{side}"),
                F.regr_sxy(y, x).alias(f"{f}__xy_{side}"),
            ]

    def statistic(f: str) -> list[Column]:
        part = {n: F.col(f"{f}__{n}") for n in
                ("n_t", "xx_t", "yy_t", "xy_t", "n_c", "xx_c", "yy_c", "xy_c")}
        slopes = [F.try_divide(part[f"xy_{s}"], part[f"xx_{s}"]) for s in "tc"]
        left = [part[f"yy_{s}"] - F.try_divide(part[f"xy_{s}"] ** 2, part[f"xx_{s}"]) for s in "tc"]
        freedom = part["n_t"] + part["n_c"] - 4
        spread = F.try_divide(left[0] + left[1], freedom)
        inverse = F.try_divide(F.lit(1.0), part["xx_t"]) + F.try_divide(F.lit(1.0), part["xx_c"])
        return [F.try_divide((slopes[0] - slopes[1]) ** 2, spread * inverse).alias("score"),
                freedom.alias("freedom")]

    table = _long(rows.agg(*aggs), features, [], statistic)
    return _placed(table.withColumn("p_value", _f_tails(F.col("score"), F.col("freedom").cast("double"))))


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + term * d)
            c = 1 + term / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def f_tail(score: float, freedom: float) -> float:
    """Upper tail of the F distribution with 1 and ``freedom`` degrees."""
    return beta_share(freedom / (freedom + score), freedom / 2, 0.5)


def _f_tails(score: Column, freedom: Column) -> Column:
    """Tails of a table with one row per feature."""

    @F.pandas_udf("double")
    def tails(scores: pd.Series, counts: pd.Series) -> pd.Series:
        pairs = zip(scores, counts, strict=True)
        return pd.Series([f_tail(s, n) if pd.notna(s) and n > 0 else None for s, n in pairs], dtype="float64")

    return tails(score, freedom)


def _placed(table: DataFrame) -> DataFrame:
    """Add the place by falling score; the table has one row per feature."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "feature")))


def _divergence(method: str, p: Column, q: Column) -> Column:
    one = F.lit(1.0)
    if method == "ED":
        return 2 * (p - q) ** 2
    if method == "Chi":
        return (p - q) ** 2 / F.greatest(F.lit(EPSILON), q) + (p - q) ** 2 / F.greatest(
            F.lit(EPSILON), one - q
        )
    q = F.least(F.greatest(q, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return p * F.log(p / q) + (one - p) * F.log((one - p) / (one - q))


def divergence_rank(
    df: DataFrame,
    features: Sequence[str],
    method: str,
    label: str = "label",
    group: str = "treatment",
    control: int = 0,
    treated: int = 1,
    n_bins: int = 10,
    id_col: str = "id",
) -> DataFrame:
    """(feature, score, parent, place): divergence of the arms' outcome rates over quantile bins.

    ``score`` is the mean over bins weighted by their rows, ``parent`` the same without bins.
    Methods are KL, ED and Chi. An outcome that a bin's arm lacks counts once, so that no rate is
    exactly 0 or 1.
    """
    if method not in ("KL", "ED", "Chi"):
        raise ValueError(f"unknown divergence: {method}")
    rows = df.filter(F.col(group).isin(control, treated))
    # cutting and counting read the rows several times
    rows = stage(rows.select(id_col, group, label, *features), "ranked")
    long = _long(rows, features, [id_col], lambda f: [F.col(f).cast("double").alias("value")])
    probabilities = [i / n_bins for i in range(1, n_bins)]
    found = exact_quantiles(long, "value", id_col, probabilities, ["feature"])
    # n_bins - 1 numbers per feature
    cuts: dict[str, set[float]] = {f: set() for f in features}
    for row in found.collect():
        cuts[row["feature"]].add(row["cut"])

    def binned(f: str) -> list[Column]:
        x = F.col(f).cast("double")
        bin_no = F.lit(0)
        for cut in sorted(cuts[f]):
            bin_no = bin_no + F.when(x > F.lit(cut), 1).otherwise(0)
        return [F.when(x.isNotNull(), bin_no).alias("bin")]

    y1 = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    y0 = F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    counts = (
        _long(rows, features, [group, label], binned)
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin", group)
        .agg(y1.alias("y1"), y0.alias("y0"))
    )

    def node(table: DataFrame, keys: list[str]) -> DataFrame:
        def total(column: str, arm: int) -> Column:
            return F.sum(F.when(F.col(group) == arm, F.col(column)))

        sides = table.groupBy(*keys).agg(
            F.sum(F.col("y1") + F.col("y0")).alias("n"),
            *[total(c, a).alias(f"{c}_{s}") for c in ("y1", "y0") for s, a in (("t", treated), ("c", control))],
        )
        ones = {s: F.greatest(F.col(f"y1_{s}"), F.lit(1)) for s in "tc"}
        zeros = {s: F.greatest(F.col(f"y0_{s}"), F.lit(1)) for s in "tc"}
        p, q = (ones[s] / (ones[s] + zeros[s]) for s in "tc")
        both = F.col("y1_t").isNotNull() & F.col("y1_c").isNotNull()
        d = F.when(both, _divergence(method, p, q)).otherwise(F.lit(0.0))
        return sides.select(*keys, "n", d.alias("d"))

    per_bin = node(counts, ["feature", "bin"])
    score = (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("score")
    parent = node(counts, ["feature"]).select("feature", F.col("d").alias("parent"))
    ranked = per_bin.groupBy("feature").agg(score).join(parent, "feature")
    order = Window.orderBy(F.desc("score"), "feature")
    return ranked.withColumn("place", F.row_number().over(order))


def _chi_square_tail(x: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def _logistic_sums(betas: np.ndarray, centre: np.ndarray, scale: np.ndarray, block: int = 1024):
    """Function over Arrow batches (y, t, features): per task and feature the sums of a Newton step.

    ``betas`` is (2 models, features, 4): intercept, treatment, feature and, in the second model only,
    their product. Sums per model: curvature (4 x 4), slope (4), log likelihood, rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(centre)
        total = np.zeros((count, 2, 22))
        for batch in batches:
            y, t, *columns = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            x = (np.stack(columns, axis=1) - centre) / scale
            for at in range(0, len(y), block):
                part = slice(at, at + block)
                known = np.isfinite(x[part])
                xs = np.where(known, x[part], 0.0)
                ts = np.broadcast_to(t[part, None], xs.shape)
                z = np.stack([known.astype(float), ts * known, xs, ts * xs], axis=2)
                for m in (0, 1):
                    eta = (z * betas[m]).sum(axis=2)
                    p = 1 / (1 + np.exp(-eta))
                    zm = z if m else z * np.array([1.0, 1.0, 1.0, 0.0])
                    rest = (y[part, None] - p) * known
                    total[:, m, :16] += np.einsum("nf,nfa,nfb->fab", p * (1 - p), zm, zm, optimize=True).reshape(count, 16)
                    total[:, m, 16:20] += np.einsum("nf,nfa->fa", rest, zm)
                    total[:, m, 20] += ((y[part, None] * eta - np.logaddexp(0, eta)) * known).sum(axis=0)
                    total[:, m, 21] += known.sum(axis=0)
        flat = total.reshape(count, 44)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["feature", "sums"])

    return run


def likelihood_ratio(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    group: str = "treatment",
    control: int = 0,
    treated: int = 1,
    max_iter: int = 50,
    tolerance: float = 1e-10,
) -> DataFrame:
    """(feature, score, p_value, place): likelihood ratio of adding the feature-by-treatment term.

    Both logistic models of all features take their Newton steps together: one aggregate per step
    gives every feature's slopes and curvatures, some 40 numbers a feature, and the steps are solved on
    the driver. Rows without the feature don't count for it. A step that lowers a likelihood is halved.
    A model without a finite maximum (a feature that separates the labels) stops at ``max_iter``.
    """
    known = F.col(group).isin(control, treated) & F.col(label).isNotNull()
    rows = df.filter(known).select(
        F.col(label).cast("double").alias("_y"), (F.col(group) == treated).cast("double").alias("_t"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )
    rows = stage(rows, "ratio")
    shape = rows.agg(*[g(f"x{i}") for i in range(len(features)) for g in (F.avg, F.stddev_pop)]).first()
    centre = np.array([shape[2 * i] or 0.0 for i in range(len(features))])
    scale = np.array([shape[2 * i + 1] or 1.0 for i in range(len(features))])
    count = len(features)
    betas, steps = np.zeros((2, count, 4)), np.zeros((2, count, 4))
    best = np.full((2, count), -np.inf)
    for _ in range(max_iter):
        sums = rows.mapInArrow(_logistic_sums(betas, centre, scale), "feature long, sums array<double>")
        sums = sums.select("feature", F.posexplode("sums").alias("at", "v")).groupBy("feature", "at").agg(F.sum("v").alias("v"))
        total = np.zeros((count, 44))
        for r in sums.collect():  # 44 numbers per feature
            total[r["feature"], r["at"]] = r["v"]
        total = total.reshape(count, 2, 22)
        gain = 0.0
        for f in range(count):
            for m in (0, 1):
                now, size = total[f, m, 20], 4 if m else 3
                if now < best[m, f] - 1e-12 * abs(best[m, f]):
                    steps[m, f] /= 2
                    betas[m, f] -= steps[m, f]
                    gain = max(gain, 2 * tolerance)
                    continue
                gain = max(gain, (now - best[m, f]) / max(1.0, abs(now)) if np.isfinite(best[m, f]) else 1.0)
                best[m, f] = now
                curve = total[f, m, :16].reshape(4, 4)[:size, :size]
                steps[m, f, :size] = np.linalg.lstsq(curve, total[f, m, 16 : 16 + size], rcond=None)[0]
                betas[m, f] += steps[m, f]
        if gain < tolerance:
            break
    results = [(f, float(2 * (best[1, i] - best[0, i])), _chi_square_tail(2 * (best[1, i] - best[0, i]))) for i, f in enumerate(features)]
    return _placed(df.sparkSession.createDataFrame(results, "feature string, score double, p_value double"))


def importance_table(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance, place) of a fitted tree model."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    table = spark.createDataFrame(values, "feature string, importance double")
    order = Window.orderBy(F.desc("importance"), "feature")
    return table.withColumn("place", F.row_number().over(order))
