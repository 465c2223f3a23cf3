"""Queries that fit models: keys, counts and ranges are checked, fitted numbers are not."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (
    ARMS_SQL,
    CALENDAR,
    DAILY_SQL,
    FEATURES,
    GMV_SQL,
    LEVELS,
    SAMPLE_SQL,
    gmv,
    hash01_sql,
    hash_sql,
    price_level,
    r,
    table,
    uplift_sample,
)
from catalog.registry import day, query, rnd
from catalog.series import BRANDS
from cohortcast.operators import feature_rank, learners, series, shared
from cohortcast.operators.arms import ARMS
from cohortcast.plans import forecast, propensity, uplift
from cohortcast.session import stage

# Few and small trees for the fits without early stopping, so that a check run stays short.
SMALL = {"maxIter": 4, "maxDepth": 3}
TINY = {"maxIter": 2, "maxDepth": 2}


def sample(spark, sf_dir):
    return stage(uplift_sample(spark, sf_dir), "sample")


def inside(*columns: str, low: float = 0.0, high: float = 1.0):
    """Whether all values are there and within the bounds."""
    return F.coalesce(F.forall(F.array(*columns), lambda v: ~F.isnan(v) & (v >= low) & (v <= high)), F.lit(False))


ARM_ROWS_SQL = f"""WITH {SAMPLE_SQL}, {ARMS_SQL}
SELECT arm, COUNT(*) AS n, TRUE AS in_range FROM sample JOIN arms ON treatment = 0 OR treatment = arm GROUP BY arm"""


@query("s_learner_uplift", ARM_ROWS_SQL)
def s_learner_uplift(spark, sf_dir):
    """AUUC per arm of a boosted model with the treatment as a feature: rows behind it, and that it is a number."""
    report = uplift.evaluate_uplift(sample(spark, sf_dir), FEATURES)
    return report.auuc.select("arm", "n", inside("auuc", "lift", low=-1e3, high=1e3).alias("in_range"))


@query("s_learner_report", f"WITH {SAMPLE_SQL} SELECT COUNT(*) AS n, TRUE AS in_range FROM sample WHERE {hash01_sql('id')} >= 0.8")
def s_learner_report(spark, sf_dir):
    """Rows of the test part and ranges of log loss, accuracy and AUC."""
    _, report = learners.fit_outcome(sample(spark, sf_dir), [*FEATURES, "treatment"])
    return report.select("n", (inside("accuracy", "auc") & (F.col("logloss") > 0)).alias("in_range"))


@query("gbt_importance", "SELECT 6::BIGINT AS n, 21::BIGINT AS places, TRUE AS whole")
def gbt_importance(spark, sf_dir):
    """Importances of six features: places 1 to 6, shares of one whole."""
    features = [*FEATURES, "treatment"]
    model, _ = learners.fit_outcome(sample(spark, sf_dir), features)
    table = feature_rank.importance_table(model, features, spark)
    whole = (F.abs(F.sum("importance") - 1) < 1e-9) & (F.min("importance") >= 0)
    return table.agg(F.countDistinct("feature").alias("n"), F.sum("place").alias("places"), whole.alias("whole"))


@query(
    "auuc_by_feature_count",
    f"WITH {ARMS_SQL} SELECT CAST(UNNEST(range(1, {len(FEATURES) + 1})) AS INT) AS n_features, arm, TRUE AS in_range FROM arms",
)
def auuc_by_feature_count(spark, sf_dir):
    rows = sample(spark, sf_dir)
    ranked = [r["feature"] for r in feature_rank.correlation_rank(rows, FEATURES).collect()]
    table = learners.auuc_by_feature_count(rows, ranked, range(1, len(FEATURES) + 1))
    return table.select("n_features", "arm", inside("auuc", low=-1e3, high=1e3).alias("in_range"))


PROPENSITY_SQL = f"WITH {SAMPLE_SQL} SELECT id, treatment, {len(ARMS)} AS n, TRUE AS in_range FROM sample"


def propensities(spark, sf_dir, out_of_fold: bool):
    rows = sample(spark, sf_dir)
    models = learners.fit_propensity(rows, FEATURES)
    scores = learners.propensity_scores(rows, models, FEATURES, ["id", "treatment"], out_of_fold=out_of_fold)
    names = [f"ps_score_{a}" for a in ARMS]
    return scores.select("id", "treatment", F.size(F.array(*names)).alias("n"), inside(*names).alias("in_range"))


@query("propensity_scores", PROPENSITY_SQL)
def propensity_scores(spark, sf_dir):
    """A propensity between 0 and 1 for every row and arm, from three folds."""
    return propensities(spark, sf_dir, False)


@query("propensity_out_of_fold", PROPENSITY_SQL)
def propensity_out_of_fold(spark, sf_dir):
    return propensities(spark, sf_dir, True)


@query(
    "matched_samples",
    f"""WITH {SAMPLE_SQL},
drawn AS (
  SELECT userid FROM sample WHERE rct_mark = 1 AND treatment > 0
  UNION ALL
  (SELECT userid FROM sample WHERE rct_mark = 0 AND treatment = 0
   QUALIFY ROW_NUMBER() OVER (ORDER BY {hash_sql('id')}, id)
     <= LEAST((SELECT COUNT(*) FROM sample WHERE rct_mark = 1 AND treatment > 0),
              (SELECT COUNT(*) // 2 FROM sample WHERE rct_mark = 0 AND treatment = 0))))
SELECT treatment, COUNT(*) AS n, TRUE AS known FROM sample
WHERE treatment > 0 AND userid NOT IN (SELECT userid FROM drawn) GROUP BY treatment""",
)
def matched_samples(spark, sf_dir):
    """Fitted propensities to the matched training sample: treated rows per arm; controls are observed ones."""
    result = propensity.matched_samples(sample(spark, sf_dir), FEATURES)
    training = stage(result.training.select("id", "treatment", "rct_mark"), "training")
    controls = training.filter("treatment = 0").agg(
        ((F.count(F.lit(1)) > 0) & (F.countDistinct("id") == F.count(F.lit(1))) & (F.max("rct_mark") == 0)).alias("known")
    )
    return training.filter("treatment > 0").groupBy("treatment").agg(F.count(F.lit(1)).alias("n")).crossJoin(controls)


@query("t_learner", f"WITH {SAMPLE_SQL} SELECT id, treatment, label, {len(ARMS) + 1} AS n, TRUE AS in_range FROM sample")
def t_learner(spark, sf_dir):
    """Outcome of every arm for every row from one model per arm."""
    arms = [0, *ARMS]
    rows = sample(spark, sf_dir)
    models = learners.fit_arm_outcomes(rows, FEATURES, arms, params=SMALL)
    table = learners.predict_arm_outcomes(models, rows, FEATURES)
    names = [f"p_{a}" for a in arms]
    return table.select("id", "treatment", "label", F.size(F.array(*names)).alias("n"), inside(*names).alias("in_range"))


@query("t_learner_auuc", f"WITH {ARMS_SQL} SELECT arm, TRUE AS in_range FROM arms")
def t_learner_auuc(spark, sf_dir):
    arms = [0, *ARMS]
    rows = sample(spark, sf_dir)
    models = learners.fit_arm_outcomes(rows, FEATURES, arms, params=SMALL)
    predicted = stage(learners.predict_arm_outcomes(models, rows, FEATURES), "predicted")
    return learners.arm_outcome_auuc(predicted, arms).select("arm", inside("lift", low=-1e3, high=1e3).alias("in_range"))


SHARED_SQL = f"""WITH {SAMPLE_SQL}
SELECT treatment, COUNT(*) AS n, SUM(id)::BIGINT AS ids, {len(ARMS) + 1} AS arms, TRUE AS in_range, TRUE AS fell
FROM sample GROUP BY treatment"""


@query("shared_arms", SHARED_SQL)
def shared_arms(spark, sf_dir):
    """A shared layer and a head per arm: every row has an outcome between 0 and 1 for every arm."""
    rows, all_arms = sample(spark, sf_dir), [0, *ARMS]
    model = shared.fit_shared(rows, FEATURES, all_arms)
    predicted = shared.predict_shared(model, rows)
    given = F.array(*[F.col(f"p_{a}") for a in all_arms])
    inside = F.forall(given, lambda p: (p > 0) & (p < 1))
    return predicted.groupBy("treatment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.max(F.size(given)).alias("arms"),
        F.bool_and(inside).alias("in_range"), F.lit(model.losses[-1] < model.losses[0]).alias("fell"),
    )


@query("shared_arms_auuc")
def shared_arms_auuc(spark, sf_dir):
    """AUUC over random per arm of the shared-layer model."""
    rows, all_arms = sample(spark, sf_dir), [0, *ARMS]
    model = shared.fit_shared(rows, FEATURES, all_arms)
    predicted = stage(shared.predict_shared(model, rows), "shared_predicted")
    return learners.arm_outcome_auuc(predicted, all_arms).select("arm", rnd("lift", 6))


HORIZON_SQL = f"""WITH {GMV_SQL}, ends AS (SELECT MAX(CAST(ancestor_order_create_dt AS DATE)) AS last FROM gmv)
SELECT CAST(h AS INT) AS horizon, CAST(last + CAST(h AS INT) AS VARCHAR) AS dt, 1::BIGINT AS n FROM ends, (SELECT UNNEST(range(1, 15)) AS h)"""


@query("horizon_forecast", HORIZON_SQL)
def horizon_forecast(spark, sf_dir):
    """The last day of each of 14 horizons has a forecast; price levels of all brands are features."""
    counts = stage(series.price_level_counts(price_level(spark, sf_dir), LEVELS, BRANDS), "counts")
    ahead, _ = forecast.horizon_forecast(
        gmv(spark, sf_dir), calendar=CALENDAR, counts=counts, params=SMALL
    )
    return ahead.groupBy("horizon", "dt").agg(F.count("y_pred").alias("n")).select("horizon", day("dt"), "n")


ENDS_SQL = """
WITH sales AS (SELECT CAST(o_orderkey % 2 AS INT) AS shop, CAST(o_orderdate AS DATE) AS day FROM orders),
spans AS (SELECT MAX(day) AS last FROM sales),
kept AS (SELECT shop, MAX(day) AS last FROM sales, spans WHERE shop = 0 OR day <= spans.last - 40 GROUP BY shop)
SELECT shop, CAST(h AS INT) AS horizon, CAST(kept.last + CAST(h AS INT) AS VARCHAR) AS dt, 1::BIGINT AS n
FROM kept, (SELECT UNNEST(range(1, 15)) AS h)"""


@query("horizon_forecast_ends", ENDS_SQL)
def horizon_forecast_ends(spark, sf_dir):
    """Two series, one ending 40 days earlier: each has the last day of every horizon."""
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 2).cast("int").alias("shop"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").alias("pay_gmv_d1"),
    )
    last = rows.agg(F.max("day")).first()[0]
    rows = rows.filter((F.col("shop") == 0) | (F.col("day") <= F.date_sub(F.lit(last), 40)))
    rows = rows.withColumn("ancestor_order_create_dt", F.col("day").cast("string"))
    ahead, _ = forecast.horizon_forecast(rows, keys=["shop"], calendar=CALENDAR, params=TINY)
    present = F.count("y_pred").alias("n")
    return ahead.groupBy("shop", "horizon", "dt").agg(present).select("shop", "horizon", day("dt"), "n")


TEST_SQL = f"""WITH {DAILY_SQL}, ends AS (SELECT MAX(dt) AS last FROM daily),
days AS (SELECT CAST(h AS INT) AS horizon, dt, label FROM daily, ends, (SELECT UNNEST(range(1, 15)) AS h) WHERE dt > last - CAST(h AS INT))
SELECT horizon, CAST(dt AS VARCHAR) AS dt, {r('label', 2, 'label')},
  CAST(ROW_NUMBER() OVER (PARTITION BY horizon ORDER BY dt) AS INT) AS nex_n_day, TRUE AS agrees FROM days"""


@query("horizon_test_errors", TEST_SQL)
def horizon_test_errors(spark, sf_dir):
    """Days, truths and day numbers of the test spans; the error is that of the forecast."""
    _, tested = forecast.horizon_forecast(
        gmv(spark, sf_dir), calendar=CALENDAR, params=SMALL
    )
    agrees = F.abs(F.col("pe") * F.col("label") - (F.col("y_pred") - F.col("label"))) <= 1e-6 * F.abs("label")
    return tested.select("horizon", day("dt"), rnd("label", 2), "nex_n_day", F.coalesce(agrees, F.lit(False)).alias("agrees"))


DIRECT_SQL = f"""WITH {DAILY_SQL}, ends AS (SELECT MAX(dt) AS last FROM daily)
SELECT CAST(k AS INT) AS step, CAST(last + CAST(k AS INT) AS VARCHAR) AS dt, 'v1' AS version, TRUE AS in_range
FROM ends, (SELECT UNNEST(range(1, 4)) AS k)"""


@query("direct_forecast", DIRECT_SQL)
def direct_forecast(spark, sf_dir):
    """Both tables: the day of each step's forecast, errors and best iterations within their ranges."""
    daily = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    rows = series.add_rolling_stats(series.add_lags(daily, 1), 1)
    features, _ = series.feature_and_label_columns(rows, "label", "y", ["dt"])
    ahead, report = forecast.direct_forecast(
        rows, features, 3, retrain_to_test=True, retrain_to_final=True, version="v1", params=SMALL
    )
    both = report.join(ahead.select("step", day("dt"), "y_pred"), "step")
    good = inside("train_mape", "valid_mape", "test_mape", high=1e3) & F.col("best_iteration").between(1, SMALL["maxIter"])
    return both.select("step", "dt", "version", (good & F.col("y_pred").isNotNull()).alias("in_range"))
