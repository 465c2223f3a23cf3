"""Samples, splits and folds driven by a hash of the id, so that they repeat exactly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.hashing import hash01, hash_int
from cohortcast.operators.ordering import equal_bins, first_rows, lay_out_hashed
from cohortcast.session import stage

# 20 % test, then 20 % of the rest for validation.
THREE_WAY = {"train": 0.64, "valid": 0.16, "test": 0.20}
TWO_WAY = {"train": 0.8, "test": 0.2}


def sample_rows(
    df: DataFrame, n: int | DataFrame, id_col: str, seed: int | Column = 0, groups: Sequence[str] = ()
) -> DataFrame:
    """Exactly n rows (of every group): those with the smallest hash. Fewer only if fewer exist."""
    return first_rows(lay_out_hashed(df, id_col, seed, groups), n)


def sample_fraction(df: DataFrame, fraction: float, id_col: str, seed: int = 0) -> DataFrame:
    """Rows whose hash falls below the fraction; no shuffle."""
    return df.filter(hash01(id_col, seed) < F.lit(float(fraction)))


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Rows in hash order. Needed only where a consumer reads rows in sequence."""
    return df.orderBy(hash_int(id_col, seed), F.col(id_col))


def assign_split(
    df: DataFrame,
    id_col: str,
    seed: int = 0,
    shares: Mapping[str, float] = THREE_WAY,
    name: str = "split",
) -> DataFrame:
    """Label every row with one of the named shares; the last share takes what is left."""
    h = hash01(id_col, seed)
    labels = list(shares)
    edge, choice = 0.0, F.lit(labels[-1])
    steps = []
    for label in labels[:-1]:
        edge = round(edge + shares[label], 12)
        steps.append((edge, label))
    for edge, label in reversed(steps):
        choice = F.when(h < F.lit(edge), F.lit(label)).otherwise(choice)
    return df.withColumn(name, choice)


def balance(
    df: DataFrame,
    side_col: str,
    id_col: str,
    seed: int | Column = 0,
    groups: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Cut the larger of two sides (0/1) down to the smaller one, within every group.

    ``counts`` may give the rows ``n`` per group and side where they are already known.
    """
    sides = [*groups, side_col]
    if counts is None:
        # one row per side, read for the sizes and for the limits
        counts = stage(df.groupBy(*sides).agg(F.count(F.lit(1)).alias("n")), "sides")
    group = Window.partitionBy(*groups)
    smaller = F.when(F.count(F.lit(1)).over(group) == 2, F.min("n").over(group)).otherwise(F.lit(0))
    limits = counts.withColumn("_keep", smaller).drop("n")
    return first_rows(lay_out_hashed(df, id_col, seed, sides, per_group=counts), limits)


def balance_groups(
    algo: DataFrame, base: DataFrame, id_col: str, seed: int = 0, concat: bool = True
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Balance two tables of the same shape; one table, or the pair when ``concat`` is off."""
    marked = algo.withColumn("_side", F.lit(1)).unionByName(base.withColumn("_side", F.lit(0)))
    balanced = balance(marked, "_side", id_col, seed)
    if concat:
        return balanced.drop("_side")
    return tuple(balanced.filter(F.col("_side") == s).drop("_side") for s in (1, 0))


def user_folds(
    df: DataFrame, user_col: str, cv: int, seed: int = 0, exact: bool = False, name: str = "fold"
) -> DataFrame:
    """Folds 0..cv-1 by user, so that a user is never in two folds.

    The default needs no shuffle and gives folds of nearly equal size. ``exact`` gives sizes that
    differ by at most one user, at the price of a pass over the distinct users and a join.
    """
    if not exact:
        return df.withColumn(name, (hash_int(user_col, seed) % cv).cast("int"))
    users = df.select(user_col).distinct()
    folds = equal_bins(lay_out_hashed(users, user_col, seed), cv, name)
    return df.join(folds.withColumn(name, F.col(name) - 1), user_col)
