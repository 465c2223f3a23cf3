"""Propensities per arm and fold: which rows a fit reads and a model scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortcast.operators import learners
from cohortcast.operators.sampling import user_folds


class OneFold:
    """Stands for a fitted model: 0.1 * arm + 0.01 * fold, and an error for rows of other folds."""

    def __init__(self, arm: int, fold: int):
        self.arm, self.fold = arm, fold

    def getParam(self, name):
        return name

    def transform(self, df, params):
        value, mine = 0.1 * self.arm + 0.01 * self.fold, self.fold

        @F.udf("double")
        def chance(fold):
            assert fold == mine, "a row of another fold"
            return value

        p = chance("fold")
        return df.withColumn("_prob", array_to_vector(F.array(1 - p, p)))


def _rows(spark):
    rows = spark.range(300).select("id", (F.col("id") % 40).alias("userid"), (F.col("id") % 4 * 3).cast("int").alias("treatment"))
    rows = rows.withColumn("userid", F.when(F.col("id") % 11 != 0, F.col("userid")))
    return rows.withColumns({"a": F.rand(1), "b": F.when(F.col("id") % 7 != 0, F.rand(2))})


def test_rows_meet_the_models_of_their_fold(spark):
    rows = _rows(spark)
    models = {arm: [OneFold(arm, fold) for fold in range(3)] for arm in (3, 6)}
    got = learners.propensity_scores(rows, models, ["a", "b"], ["id"], out_of_fold=True).toPandas().set_index("id")
    folds = user_folds(rows, "userid", 3).toPandas().set_index("id")["fold"]
    assert len(got) == 300 and got.index.is_unique
    for arm in (3, 6):
        assert ((got[f"ps_score_{arm}"] - (0.1 * arm + 0.01 * folds)).abs() < 1e-12).all()


def test_a_fit_reads_its_arm_and_control(spark, monkeypatch):
    seen = []

    def fits(rows, cv, params):
        seen.append((sum("_arm=" in f for f in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}), rows.count(), rows.agg(F.sum("label")).first()[0]))
        return [lambda: None] * cv

    monkeypatch.setattr(learners, "fit_user_folds", fits)
    learners.fit_propensity(_rows(spark), ["a", "b"], arms=(3, 6))
    assert seen == [(2, 150, 75.0), (2, 150, 75.0)]
