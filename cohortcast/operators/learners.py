"""Boosted trees from MLlib: outcome models, propensity models, forecasts.

Loops run only around ``fit``. Scoring adds columns to the rows, so it needs neither a join nor a
copy of the rows per arm or fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.operators.arms import ARMS, SCORE_PREFIX, arms_long
from cohortcast.operators.boosting import PATIENCE, best_iteration, prefix_losses, read_trees, tree_outputs
from cohortcast.operators.curves import auuc, auuc_over_random
from cohortcast.operators.frames import unite
from cohortcast.operators.metrics import classification_report
from cohortcast.operators.sampling import THREE_WAY, assign_split, user_folds
from cohortcast.session import in_parallel, stage, stage_parts

# Learning rate, row and column share per tree, depth near 31 and 90 leaves.
CLASSIFIER = {"maxIter": 100, "stepSize": 0.05, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.9", "maxDepth": 5, "seed": 7}
REGRESSOR = {"maxIter": 130, "stepSize": 0.05, "subsamplingRate": 0.8,
             "featureSubsetStrategy": "0.8", "maxDepth": 10, "seed": 7}
# A value no feature takes: trees put missing values in a bin of their own.
MISSING = -1.0e9


def assemble(
    df: DataFrame, features: Sequence[str], output: str = "features", **fixed: Column
) -> DataFrame:
    """Add a feature vector; ``fixed`` replaces single features, missing values become ``MISSING``."""
    inputs = {
        f"_{output}_{i}": F.coalesce(fixed.get(f, F.col(f)).cast("double"), F.lit(MISSING))
        for i, f in enumerate(features)
    }
    vectors = VectorAssembler(inputCols=list(inputs), outputCol=output)
    return vectors.transform(df.withColumns(inputs)).drop(*inputs)


def add_probability(model: Model, df: DataFrame, features: str, name: str) -> DataFrame:
    """Add the probability of class 1 and drop the feature vector."""
    columns = {"featuresCol": features, "probabilityCol": "_prob", "rawPredictionCol": "",
               "predictionCol": ""}
    scored = model.transform(df, {model.getParam(k): v for k, v in columns.items()})
    return scored.withColumn(name, vector_to_array("_prob")[1]).drop("_prob", features)


def fit_predict(estimator, df: DataFrame) -> DataFrame:
    """Fit on a table and score the same table."""
    return estimator.fit(df).transform(df)


# ---- outcome model with the treatment as a feature ---------------------------------------------


def fit_outcome(
    df: DataFrame,
    features: Sequence[str],
    target: str = "label",
    id_col: str = "id",
    seed: int = 0,
    params: Mapping | None = None,
) -> tuple[Model, DataFrame]:
    """(model, report): boosted trees on 64 % with 16 % for validation, report on the other 20 %."""
    rows = assign_split(df, id_col, seed, THREE_WAY)
    rows = assemble(rows, features).select(
        "features", F.col(target).cast("double").alias("label"), "split"
    )
    rows = stage(rows, "outcome")
    fitting = rows.filter("split <> 'test'").withColumn("held", F.col("split") == "valid")
    model = GBTClassifier(validationIndicatorCol="held", **{**CLASSIFIER, **(params or {})}).fit(fitting)
    tested = add_probability(model, rows.filter("split = 'test'"), "features", "p")
    return model, classification_report(tested, "p", "label")


def score_arms(
    model: Model,
    df: DataFrame,
    features: Sequence[str],
    arms: Sequence[int] = ARMS,
    treatment: str = "treatment",
    keep: Sequence[str] = ("id", "treatment", "label"),
) -> DataFrame:
    """Predicted effect of every arm: probability with the arm set minus that with control set."""
    rows = df
    for arm in (0, *arms):
        rows = assemble(rows, features, "_v", **{treatment: F.lit(arm)})
        rows = add_probability(model, rows, "_v", f"_p_{arm}")
    effects = [(F.col(f"_p_{a}") - F.col("_p_0")).alias(f"{SCORE_PREFIX}{a}") for a in arms]
    return rows.select(*keep, *effects)


def auuc_by_feature_count(
    df: DataFrame,
    ranked: Sequence[str],
    counts: Sequence[int],
    arms: Sequence[int] = ARMS,
    treatment: str = "treatment",
    label: str = "label",
    id_col: str = "id",
    params: Mapping | None = None,
) -> DataFrame:
    """(n_features, arm, auuc): refit with the first features of a ranking and score all rows."""
    parts = []
    for n in counts:
        features = [*ranked[:n], treatment]
        model, _ = fit_outcome(df, features, label, id_col, params=params)
        scored = stage(score_arms(model, df, features, arms, treatment), "scored")
        table = auuc(arms_long(scored, arms, id_col)).select("arm", "auuc")
        parts.append(table.withColumn("n_features", F.lit(n)))
    return unite(parts).select("n_features", "arm", "auuc")


# ---- propensity models -------------------------------------------------------------------------


def fit_user_folds(
    rows: DataFrame, cv: int, params: Mapping | None = None
) -> list[Callable[[], Model]]:
    """One fit per fold of ``rows`` (features, label, fold); the fold itself is the validation set."""
    def fit(fold: int) -> Callable[[], Model]:
        def run() -> Model:
            marked = rows.withColumn("held", F.col("fold") == fold)
            settings = {**CLASSIFIER, **(params or {})}
            return GBTClassifier(validationIndicatorCol="held", **settings).fit(marked)

        return run

    return [fit(i) for i in range(cv)]


def fit_propensity(
    df: DataFrame,
    features: Sequence[str],
    arms: Sequence[int] = ARMS,
    treatment: str = "treatment",
    user_col: str = "userid",
    cv: int = 3,
    seed: int = 0,
    params: Mapping | None = None,
) -> dict[int, list[Model]]:
    """Per arm one model per user fold for 'this arm rather than control'."""
    rows = assemble(user_folds(df, user_col, cv, seed), features).filter(F.col(treatment).isin(0, *arms))
    # a folder per arm, so that each of the fits reads the rows of its arm and of control only
    rows = rows.select(F.col(treatment).cast("int").alias("_arm"), "features", "fold")
    parts = stage_parts(rows, "_arm", [0, *arms], "propensity")
    jobs = []
    for arm in arms:
        pair = unite([parts[k].withColumn("label", F.lit(float(k > 0))) for k in (0, arm)])
        jobs += fit_user_folds(pair, cv, params)
    models = in_parallel(df.sparkSession, jobs)
    return {arm: models[i * cv : (i + 1) * cv] for i, arm in enumerate(arms)}


def propensity_scores(
    df: DataFrame,
    models: Mapping[int, Sequence[Model]],
    features: Sequence[str],
    keep: Sequence[str],
    out_of_fold: bool = False,
    user_col: str = "userid",
    seed: int = 0,
) -> DataFrame:
    """The kept columns and ``ps_score_{arm}``: the mean over an arm's fold models.

    ``out_of_fold`` takes instead the one model that has not seen the row's user; ``df`` is then read once per fold.
    """
    cv = len(next(iter(models.values())))
    if out_of_fold:  # a row meets the models of its own fold only
        rows = assemble(user_folds(df, user_col, cv, seed), features, "_all")
        parts = []
        for fold in range(cv):
            part = rows.filter(F.col("fold") == fold)
            for arm, folds in models.items():
                part = add_probability(folds[fold], part.withColumn("_v", F.col("_all")), "_v", f"ps_score_{arm}")
            parts.append(part.select(*keep, *[f"ps_score_{arm}" for arm in models]))
        return unite(parts)
    rows = assemble(df, features, "_all")
    scores = []
    for arm, folds in models.items():
        names = [f"_p_{arm}_{i}" for i in range(len(folds))]
        for name, model in zip(names, folds):
            rows = add_probability(model, rows.withColumn("_v", F.col("_all")), "_v", name)
        value = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        scores.append(value.alias(f"ps_score_{arm}"))
    return rows.select(*keep, *scores)


# ---- one outcome model per arm -----------------------------------------------------------------


def fit_arm_outcomes(
    df: DataFrame,
    features: Sequence[str],
    arms: Sequence[int],
    treatment: str = "treatment",
    label: str = "label",
    params: Mapping | None = None,
) -> dict[int, Model]:
    """One classifier per arm, fitted on the arm's own rows; include control 0 in ``arms``."""
    rows = assemble(df, features).select(
        treatment, "features", F.col(label).cast("double").alias("label")
    )
    rows = stage(rows, "arms")

    def fit(arm: int) -> Callable[[], Model]:
        own = rows.filter(F.col(treatment) == arm)
        return lambda: GBTClassifier(**{**CLASSIFIER, **(params or {})}).fit(own)

    return dict(zip(arms, in_parallel(df.sparkSession, [fit(a) for a in arms])))


def predict_arm_outcomes(
    models: Mapping[int, Model],
    df: DataFrame,
    features: Sequence[str],
    keep: Sequence[str] = ("id", "treatment", "label"),
) -> DataFrame:
    """The kept columns and the predicted outcome ``p_{arm}`` under every arm."""
    rows = assemble(df, features, "_all")
    for arm, model in models.items():
        rows = add_probability(model, rows.withColumn("_v", F.col("_all")), "_v", f"p_{arm}")
    return rows.select(*keep, *[f"p_{a}" for a in models])


def arm_outcome_auuc(predicted: DataFrame, arms: Sequence[int], id_col: str = "id") -> DataFrame:
    """(arm, lift): AUUC over random of ``p_{arm} - p_0``."""
    treated = [a for a in arms if a != 0]
    wide = predicted.select(
        id_col, "treatment", "label",
        *[(F.col(f"p_{a}") - F.col("p_0")).alias(f"{SCORE_PREFIX}{a}") for a in treated],
    )
    return auuc_over_random(arms_long(wide, treated, id_col))


# ---- regression with a best iteration ----------------------------------------------------------


def fit_best(
    train: DataFrame, valid: DataFrame, params: Mapping | None = None, criterion: str = "relative", patience: int | None = PATIENCE
) -> tuple[Model, int]:
    """(model, best iteration) for tables with features and label.

    Best is the prefix of trees with the least mean loss on the validation rows, relative or squared,
    before ``patience`` rounds without gain. The outputs of all prefixes are one pass over the rows.
    """
    settings = {**REGRESSOR, **(params or {})}
    model = GBTRegressor(**settings).fit(train)
    weights, trees = read_trees(model.toDebugString)
    rows = valid.select("label", tree_outputs(trees, weights).alias("prefixes"))
    found = {r["iteration"]: r["loss"] for r in prefix_losses(rows, "prefixes", criterion=criterion).collect()}
    best, _ = best_iteration([found[k] for k in sorted(found)], patience)
    return model, best


def refit(rows: DataFrame, best: int, params: Mapping | None = None) -> Model:
    """The same trees up to the best iteration, fitted on all given rows."""
    return GBTRegressor(**{**REGRESSOR, **(params or {}), "maxIter": best}).fit(rows)
