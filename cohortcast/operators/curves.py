"""Uplift curves and scores: cumulative lift, gain, AUUC, Qini, calibration by score bin.

With k the rank by descending score and N_t, N_c, Y_t, Y_c the running counts and outcomes,
lift(k) = Y_t/N_t - Y_c/N_c, gain(k) = k * lift(k), qini(k) = Y_t - Y_c * N_t / N_c, and 0 at k = 0.
Leading ranks where a rate is still undefined lie on the straight line from 0 to the first defined
value. The random curve is the straight line from 0 to the last value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.scalars import percentile_label
from cohortcast.operators.ordering import (
    GROUP,
    ROWS_PER_BUCKET,
    Layout,
    equal_bins,
    first_rows,
    group_key,
    lay_out,
)
from cohortcast.operators.repeats import repeated_areas
from cohortcast.session import stage

SUMS = ("n_t", "n_c", "y_t", "y_c")


def _sums(treatment: str, label: str) -> dict[str, Column]:
    t, y = F.col(treatment), F.col(label)
    treated = (t > 0).cast("long")
    return {
        "n_t": treated,
        "n_c": F.lit(1) - treated,
        "y_t": F.when(t > 0, y).otherwise(F.lit(0)),
        "y_c": F.when(t > 0, F.lit(0)).otherwise(y),
    }


def _lift() -> Column:
    return F.try_divide("y_t", "n_t") - F.try_divide("y_c", "n_c")


def _qini() -> Column:
    return F.col("y_t") - F.try_divide(F.col("y_c") * F.col("n_t"), F.col("n_c"))


def _value(kind: str) -> Column:
    """The curve whose leading gap is a straight line: lift (also for gain) or qini."""
    return _qini() if kind == "qini" else _lift()


def _spans(layout: Layout, sums: dict[str, Column]) -> DataFrame:
    """Counts and sums per bucket, written once for the passes that need them."""
    return stage(layout.offsets(**sums), "spans")


def _lead(layout: Layout, spans: DataFrame, sums: dict[str, Column], kind: str) -> DataFrame:
    """Per group the first rank ``m`` with a defined value ``v_m``.

    Only the bucket in which the value becomes defined is sorted.
    """
    needed = ("n_c",) if kind == "qini" else ("n_t", "n_c")
    seen_before = F.lit(True)
    seen_after = F.lit(True)
    for name in needed:
        before = F.col(f"_b_{name}")
        seen_before &= before > 0
        seen_after &= before + F.col(f"_s_{name}") > 0
    crossing = spans.filter(seen_after & ~seen_before)
    rows = layout.rows.join(layout.small(crossing.select(*layout.keys)), layout.keys, "left_semi")
    running = layout.running(rows, spans, **sums).withColumn("v", _value(kind))
    return (
        running.filter(F.col("v").isNotNull())
        .groupBy(GROUP)
        .agg(F.min("k").alias("m"), F.min_by("v", "k").alias("v_m"))
    )


def _ends(layout: Layout, spans: DataFrame, kind: str) -> DataFrame:
    """Per group the row count ``n`` and the curve's last value ``v_n``."""
    totals = spans.groupBy(GROUP).agg(
        F.sum("_n").alias("n"), *[F.sum(f"_s_{name}").alias(name) for name in SUMS]
    )
    last = F.coalesce(_value(kind).cast("double"), F.lit(0.0))
    return totals.select(GROUP, "n", last.alias("v_n"))


def uplift_curve(
    df: DataFrame,
    kind: str = "lift",
    groups: Sequence[str] = ("arm",),
    treatment: str = "treatment",
    label: str = "label",
    score: str = "uplift",
    id_col: str = "id",
    normalize: bool = False,
    keep_random: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Curve as (groups, k, value[, random]) for k = 0..N; ``kind`` is lift, gain or qini.

    ``normalize`` divides by the size of the last value; NULL where that is 0.
    """
    if kind not in ("lift", "gain", "qini"):
        raise ValueError(f"unknown curve: {kind}")
    groups = list(groups)
    layout = lay_out(df, score, id_col, groups, rows_per_bucket=rows_per_bucket)
    sums = _sums(treatment, label)
    spans = _spans(layout, sums)
    running = layout.running(spans=spans, **sums)
    running = running.select(GROUP, *groups, "k", _value(kind).cast("double").alias("v"))
    ends, lead = _ends(layout, spans, kind), _lead(layout, spans, sums, kind)
    curve = running.join(layout.small(ends.join(lead, GROUP, "left")), GROUP, "left")
    # the first row of a group also makes the point at 0
    point = F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"), F.col("k")))
    curve = curve.withColumn("at", F.explode(F.coalesce(point, F.array("k"))))
    curve = curve.withColumns(
        {"k": F.col("at"), "v": F.when(F.col("at") == 0, F.lit(0.0)).otherwise(F.col("v"))}
    )
    ramp = F.coalesce(F.col("v_m") * F.col("k") / F.col("m"), F.lit(0.0))
    value = F.coalesce(F.col("v"), ramp)
    last = F.col("v_n")
    if kind == "gain":
        value, last = value * F.col("k"), last * F.col("n")
    line = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(
        F.col("v_n") if kind == "lift" else last * F.col("k") / F.col("n")
    )
    if normalize:
        value, line = F.try_divide(value, F.abs(last)), F.try_divide(line, F.abs(last))
    columns = [value.alias("value")] + ([line.alias("random")] if keep_random else [])
    return curve.select(*groups, "k", *columns)


def _areas(
    df: DataFrame,
    kind: str,
    groups: Sequence[str],
    treatment: str,
    label: str,
    score: str,
    id_col: str,
    rows_per_bucket: int,
) -> DataFrame:
    """Per group: n, the sum of the curve over k = 0..n, and its last value.

    The leading gap adds a closed form, so that no row-level join is needed.
    """
    layout = lay_out(df, score, id_col, groups, rows_per_bucket=rows_per_bucket)
    running = layout.running(**_sums(treatment, label)).withColumn("v", _value(kind).cast("double"))
    point = F.col("v") if kind == "qini" else F.col("v") * F.col("k")
    per_group = running.groupBy(*groups).agg(
        F.max("k").alias("n"),
        F.sum(point).alias("body"),
        F.min(F.when(F.col("v").isNotNull(), F.col("k"))).alias("m"),
        F.min_by("v", F.when(F.col("v").isNotNull(), F.col("k"))).alias("v_m"),
        F.max_by(point, "k").alias("last"),
    )
    m = F.col("m").cast("double")
    if kind == "qini":
        lead = F.col("v_m") * (m - 1) / 2
    else:
        lead = F.col("v_m") * (m - 1) * (2 * m - 1) / 6
    area = F.coalesce(F.col("body") + lead, F.lit(0.0))
    last = F.coalesce(F.col("last"), F.lit(0.0))
    return per_group.select(*groups, "n", area.alias("area"), last.alias("last"))


def auuc(
    df: DataFrame,
    groups: Sequence[str] = ("arm",),
    treatment: str = "treatment",
    label: str = "label",
    score: str = "uplift",
    id_col: str = "id",
    normalize: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Area under the gain curve: (groups, n, auuc, random, lift = auuc - random)."""
    areas = _areas(df, "gain", groups, treatment, label, score, id_col, rows_per_bucket)
    value = F.col("area") / (F.col("n") + 1)
    line = F.col("last") / 2
    if normalize:
        value, line = (F.try_divide(c, F.abs("last")) for c in (value, line))
    return areas.select(
        *groups, "n", value.alias("auuc"), line.alias("random"), (value - line).alias("lift")
    )


def auuc_over_random(df: DataFrame, groups: Sequence[str] = ("arm",), **columns) -> DataFrame:
    """Normalised AUUC minus that of the straight line: (groups, lift)."""
    return auuc(df, groups, normalize=True, **columns).select(*groups, "lift")


def qini_score(
    df: DataFrame,
    groups: Sequence[str] = ("arm",),
    treatment: str = "treatment",
    label: str = "label",
    score: str = "uplift",
    id_col: str = "id",
    normalize: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Area between the Qini curve and its straight line: (groups, n, qini)."""
    areas = _areas(df, "qini", groups, treatment, label, score, id_col, rows_per_bucket)
    value = F.col("area") / (F.col("n") + 1) - F.col("last") / 2
    if normalize:
        value = F.try_divide(value, F.abs("last"))
    return areas.select(*groups, "n", value.alias("qini"))


def auuc_repeated(
    df: DataFrame,
    sample_times: int = 50,
    groups: Sequence[str] = ("arm",),
    treatment: str = "treatment",
    label: str = "label",
    score: str = "uplift",
    id_col: str = "id",
) -> DataFrame:
    """AUUC over random on balanced samples: (groups, seed, lift) for seeds 0..sample_times-1.

    All repeats are one sorted pass: rows carry a bit per repeat (see ``operators/repeats``).
    """
    areas = repeated_areas(df, sample_times, groups, treatment, label, score, id_col)
    value, line = F.col("area") / (F.col("n") + 1), F.col("last") / 2
    return areas.select(*groups, "seed", F.try_divide(value - line, F.abs("last")).alias("lift"))


def auuc_mean(df: DataFrame, sample_times: int = 50, groups: Sequence[str] = ("arm",), **columns) -> DataFrame:
    """Mean of :func:`auuc_repeated` per group: (groups, samples, lift)."""
    repeats = auuc_repeated(df, sample_times, groups, **columns)
    return repeats.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("lift").alias("lift")
    )


def top_n_lift(
    df: DataFrame,
    n: int,
    groups: Sequence[str] = ("arm",),
    treatment: str = "treatment",
    label: str = "label",
    score: str = "uplift",
    id_col: str = "id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Cumulative lift at rank min(n, N): (groups, k, lift)."""
    groups = list(groups)
    layout = lay_out(df, score, id_col, groups, rows_per_bucket=rows_per_bucket)
    sums = _sums(treatment, label)
    spans = _spans(layout, sums)
    top = first_rows(layout, n, spans).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    lead = _lead(layout, spans, sums, "lift")
    both = top.withColumn(GROUP, group_key(groups)).join(lead, GROUP, "left")
    ramp = F.coalesce(F.col("v_m") * F.col("k") / F.col("m"), F.lit(0.0))
    return both.select(*groups, "k", F.coalesce(_lift().cast("double"), ramp).alias("lift"))


def calibration(
    df: DataFrame,
    bins: int = 10,
    groups: Sequence[str] = ("arm",),
    treatment: str = "treatment",
    label: str = "label",
    score: str = "uplift",
    id_col: str = "id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per score bin: mean predicted effect, observed effect and their difference.

    (groups, bin, percentile, avgite, cate, diff); ``cate`` is NULL where a side has no rows.
    """
    layout = lay_out(df, score, id_col, groups, rows_per_bucket=rows_per_bucket)
    binned = equal_bins(layout, bins)
    t = F.col(treatment)
    per_bin = binned.groupBy(*groups, "bin").agg(
        F.avg(score).alias("avgite"),
        (F.avg(F.when(t > 0, F.col(label))) - F.avg(F.when(t == 0, F.col(label)))).alias("cate"),
    )
    return per_bin.select(
        *groups,
        "bin",
        percentile_label("bin", bins).alias("percentile"),
        "avgite",
        "cate",
        (F.col("cate") - F.col("avgite")).alias("diff"),
    )
