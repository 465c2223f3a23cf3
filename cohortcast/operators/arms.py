"""Treatment arms: comparison tables, per-arm samples, splits and gathers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.functions.scalars import treated_flag, treated_text
from cohortcast.operators.frames import unite
from cohortcast.operators.sampling import balance
from cohortcast.session import stage_parts

# The arms the scoring step knows, next to control 0.
ARMS = (3, 4, 5, 6, 7, 8, 9, 10)
SCORE_PREFIX = "uplift_"


def keep_arm(df: DataFrame, arm: int, treatment: str = "treatment", control: int = 0) -> DataFrame:
    """Rows of control and of one arm."""
    return df.filter(F.col(treatment).isin(control, arm))


def binary_treatment(df: DataFrame, treatment: str = "treatment") -> DataFrame:
    return df.withColumn(treatment, treated_flag(treatment))


def arm_comparison(df: DataFrame, arm: int, keep: Sequence[str] = ()) -> DataFrame:
    """One arm against control: treatment 0/1, label and that arm's score."""
    rows = binary_treatment(keep_arm(df, arm))
    return rows.select(*keep, "treatment", "label", f"{SCORE_PREFIX}{arm}")


def arm_scores(
    df: DataFrame,
    treatment: str,
    label: str,
    arm: int,
    score: str,
    control: int = 0,
    split: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Like :func:`arm_comparison` with free column names; (treated, control) when ``split``."""
    rows = keep_arm(df, arm, treatment, control).select(*keep, treatment, label, score)
    if not split:
        return binary_treatment(rows, treatment)
    algo = rows.filter(F.col(treatment) == arm)
    base = rows.filter(F.col(treatment) == control)
    return binary_treatment(algo, treatment), binary_treatment(base, treatment)


def arms_long(df: DataFrame, arms: Sequence[int] = ARMS, id_col: str = "id") -> DataFrame:
    """Every arm against control at once: (arm, id, treatment 0/1, label, uplift).

    Controls are repeated per arm, a treated row appears under its own arm. No join, no shuffle.
    """
    scores = F.array(
        *[
            F.struct(F.lit(a).alias("arm"), F.col(f"{SCORE_PREFIX}{a}").alias("uplift"))
            for a in arms
        ]
    )
    own = F.filter(scores, lambda s: s["arm"] == F.col("treatment"))
    used = F.when(F.col("treatment") == 0, scores).otherwise(own)
    rows = df.select(id_col, "treatment", "label", F.explode(used).alias("s"))
    return rows.select(
        F.col("s.arm").alias("arm"),
        id_col,
        treated_flag("treatment").alias("treatment"),
        "label",
        F.col("s.uplift").alias("uplift"),
    )


def arms_wide(
    long: DataFrame, arms: Sequence[int] = ARMS, id_col: str = "id", value: str = "uplift"
) -> DataFrame:
    """Scores per row and arm back to one column per arm."""
    picks = [
        F.max(F.when(F.col("arm") == a, F.col(value))).alias(f"{SCORE_PREFIX}{a}") for a in arms
    ]
    return long.groupBy(id_col).agg(*picks)


def arm_sample(
    df: DataFrame,
    arm: int,
    treatment: str = "treatment",
    balanced: bool = False,
    id_col: str = "id",
    seed: int = 0,
) -> DataFrame:
    """One arm's sample with the treatment as '0'/'1', on request cut to equal sides."""
    rows = keep_arm(df, arm, treatment).withColumn(treatment, treated_text(treatment))
    return balance(rows, treatment, id_col, seed) if balanced else rows


def split_treated(df: DataFrame, treatment: str = "treatment") -> tuple[DataFrame, DataFrame]:
    """(treated, control)."""
    return df.filter(F.col(treatment) > 0), df.filter(F.col(treatment) == 0)


def map_arms(
    df: DataFrame,
    arms: Sequence[int],
    transform: Callable[[DataFrame, int], DataFrame],
    treatment: str = "treatment",
) -> DataFrame:
    """Send the rows of every arm through its own transform and gather the results by name.

    The input is read once and dealt to a folder per arm; a transform reads its arm's rows only. The
    caller's id column keeps the rows identifiable; rows of other arms are left out.
    """
    parts = stage_parts(df.withColumn("arm_of", F.col(treatment)), "arm_of", list(arms), "arms")
    return unite([transform(parts[a], a) for a in arms])


def mark_treated(df: DataFrame, treatment: str = "treatment", name: str = "side") -> DataFrame:
    """Rows with their side, ``treated`` or ``control``; for what needs both sides in one pass."""
    side = F.when(F.col(treatment) > 0, "treated").when(F.col(treatment) == 0, "control")
    return df.withColumn(name, side).filter(F.col(name).isNotNull())
