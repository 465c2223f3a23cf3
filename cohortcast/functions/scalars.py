"""Scalar and vector expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortcast.functions.hashing import as_column


def treated_flag(treatment: str | Column) -> Column:
    """1 for any treated arm, 0 for control."""
    return (as_column(treatment) > 0).cast("int")


def treated_text(treatment: str | Column) -> Column:
    """'0' for control, '1' for anything else."""
    return F.when(as_column(treatment) == 0, F.lit("0")).otherwise(F.lit("1"))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(x)))


def over_threshold(p: str | Column, threshold: float = 0.5) -> Column:
    """1 when the probability is strictly above the threshold."""
    return (as_column(p) > F.lit(threshold)).cast("int")


def growth_weight(x: str | Column, r: float = 10.0) -> Column:
    """r / (1 + e^(-2x)) + 1 - r/2: 1 at x = 0, rising to 1 + r/2."""
    return F.lit(float(r)) / (F.lit(1.0) + F.exp(F.lit(-2.0) * as_column(x))) + F.lit(1.0 - r / 2.0)


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    gaps = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v * v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def softmax(a: str | Column) -> Column:
    """Softmax of an array, shifted by its largest element."""
    arr = as_column(a)
    weights = F.transform(arr, lambda v: F.exp(v.cast("double") - F.array_max(arr).cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(weights, lambda v: v / total)


def percentile_label(bin_no: str | Column, bins: int) -> Column:
    """'0-10', '10-20', ... for bins numbered from 1; edges are rounded half to even."""
    def edge(position: Column) -> Column:
        return F.bround(position.cast("double") * 100.0 / bins, 0).cast("int").cast("string")

    b = as_column(bin_no)
    return F.concat_ws("-", edge(b - 1), edge(b))
