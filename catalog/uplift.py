"""Queries over uplift samples: arms, sampling, curves and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (
    BASE_SQL,
    LONG_SQL,
    hash01_sql,
    hash_sql,
    r,
    uplift_base,
    uplift_wide,
)
from catalog.registry import query, rnd
from cohortcast.operators import arms, curves, sampling
from cohortcast.operators.ordering import lay_out_hashed

ORDER_SQL = f"uplift DESC, {hash_sql('id')}, id"

RANKED_SQL = (
    LONG_SQL
    + f""",
ranked AS (
  SELECT arm, k, uplift, treatment, label,
         SUM(treatment) OVER w AS n_t, SUM(1 - treatment) OVER w AS n_c,
         SUM(treatment * label) OVER w AS y_t, SUM((1 - treatment) * label) OVER w AS y_c
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY {ORDER_SQL}) AS k FROM long)
  WINDOW w AS (PARTITION BY arm ORDER BY k ROWS UNBOUNDED PRECEDING)),
raw AS (
  SELECT *, CASE WHEN n_t > 0 AND n_c > 0
                 THEN CAST(y_t AS DOUBLE) / n_t - CAST(y_c AS DOUBLE) / n_c END AS lift,
         CASE WHEN n_c > 0 THEN y_t - CAST(y_c * n_t AS DOUBLE) / n_c END AS qini
  FROM ranked),
firsts AS (
  SELECT arm, MIN(k) FILTER (lift IS NOT NULL) AS m,
         ARG_MIN(lift, k) FILTER (lift IS NOT NULL) AS lift_m,
         MIN(k) FILTER (qini IS NOT NULL) AS mq,
         ARG_MIN(qini, k) FILTER (qini IS NOT NULL) AS qini_m,
         MAX(k) AS n, ARG_MAX(lift, k) AS lift_n, ARG_MAX(qini, k) AS qini_n
  FROM raw GROUP BY arm),
curve AS (
  SELECT r.arm, r.k, COALESCE(r.lift, f.lift_m * r.k / f.m, 0.0) AS lift,
         COALESCE(r.qini, f.qini_m * r.k / f.mq, 0.0) AS qini, f.n, f.lift_n, f.qini_n
  FROM raw r JOIN firsts f ON f.arm = r.arm
  UNION ALL
  SELECT arm, 0, 0.0, 0.0, n, lift_n, qini_n FROM firsts)"""
)


def scored(spark, sf_dir):
    return arms.arms_long(uplift_wide(spark, sf_dir))


DECILE_SQL = f"""WITH {LONG_SQL},
binned AS (
  SELECT *, NTILE(10) OVER (PARTITION BY arm ORDER BY {ORDER_SQL}) AS bin FROM long),
per_bin AS (
  SELECT arm, bin, AVG(uplift) AS avgite,
         AVG(label) FILTER (treatment = 1) - AVG(label) FILTER (treatment = 0) AS cate
  FROM binned GROUP BY arm, bin)
SELECT arm, CAST(bin AS INT) AS bin,
       CAST((bin - 1) * 10 AS VARCHAR) || '-' || CAST(bin * 10 AS VARCHAR) AS percentile,
       {r('avgite', 8, 'avgite')}, {r('cate', 8, 'cate')}, {r('cate - avgite', 8, 'diff')}
FROM per_bin"""


@query("uplift_decile", DECILE_SQL)
def uplift_decile(spark, sf_dir):
    bins = curves.calibration(scored(spark, sf_dir))
    return bins.select(
        "arm", "bin", "percentile", rnd("avgite", 8), rnd("cate", 8), rnd("diff", 8)
    )


@query(
    "uplift_scores_long",
    f"WITH {LONG_SQL} SELECT arm, id, treatment, label, {r('uplift', 9, 'uplift')} FROM long",
)
def uplift_scores_long(spark, sf_dir):
    return scored(spark, sf_dir).select("arm", "id", "treatment", "label", rnd("uplift", 9))


@query(
    "arm_comparison",
    f"""WITH {LONG_SQL}
SELECT id, treatment, label, {r('uplift', 9, 'uplift_3')} FROM long WHERE arm = 3""",
)
def arm_comparison(spark, sf_dir):
    rows = arms.arm_comparison(uplift_wide(spark, sf_dir), 3, keep=["id"])
    return rows.select("id", "treatment", "label", rnd("uplift_3", 9))


@query(
    "treatment_split",
    f"""WITH {LONG_SQL}
SELECT CASE WHEN treatment = 1 THEN 'algo' ELSE 'base' END AS side, treatment, label, COUNT(*) AS n,
       {r('SUM(uplift)', 6, 'uplift')}
FROM long WHERE arm = 4 GROUP BY ALL""",
)
def treatment_split(spark, sf_dir):
    algo, base = arms.arm_scores(
        uplift_wide(spark, sf_dir), "treatment", "label", 4, "uplift_4"
    )
    both = algo.withColumn("side", F.lit("algo")).unionByName(base.withColumn("side", F.lit("base")))
    return both.groupBy("side", "treatment", "label").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("uplift_4"), 6, "uplift")
    )


@query(
    "treat_sample_balanced",
    f"""WITH {BASE_SQL},
pair AS (SELECT id, CASE WHEN treatment = 0 THEN '0' ELSE '1' END AS treatment, label
         FROM base WHERE treatment IN (0, 5)),
least_side AS (SELECT MIN(n) AS keep FROM (SELECT COUNT(*) AS n FROM pair GROUP BY treatment)),
ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY treatment ORDER BY {hash_sql('id', '7')}, id) AS pos
            FROM pair)
SELECT id, treatment, label FROM ordered, least_side WHERE pos <= keep""",
)
def treat_sample_balanced(spark, sf_dir):
    rows = arms.arm_sample(uplift_base(spark, sf_dir), 5, balanced=True, seed=7)
    return rows.select("id", "treatment", "label")


@query(
    "treat_sample_text",
    f"""WITH {BASE_SQL}
SELECT CASE WHEN treatment = 0 THEN '0' ELSE '1' END AS treatment, COUNT(*) AS n
FROM base WHERE treatment IN (0, 6) GROUP BY 1""",
)
def treat_sample_text(spark, sf_dir):
    rows = arms.arm_sample(uplift_base(spark, sf_dir), 6)
    return rows.groupBy("treatment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_exact_rows",
    f"""WITH {BASE_SQL}
SELECT id, treatment FROM base ORDER BY {hash_sql('id', '11')}, id LIMIT 1000""",
)
def sample_exact_rows(spark, sf_dir):
    return sampling.sample_rows(uplift_base(spark, sf_dir), 1000, "id", 11).select("id", "treatment")


@query(
    "sample_fraction",
    f"WITH {BASE_SQL} SELECT id, label FROM base WHERE {hash01_sql('id', '5')} < 0.66",
)
def sample_fraction(spark, sf_dir):
    rows = sampling.sample_fraction(uplift_base(spark, sf_dir), 0.66, "id", 5)
    return rows.select("id", "label")


@query(
    "shuffle_rows",
    f"""WITH {BASE_SQL}
SELECT id, ROW_NUMBER() OVER (ORDER BY {hash_sql('id', '3')}, id) AS place FROM base""",
)
def shuffle_rows(spark, sf_dir):
    """Every row's place in the shuffled order."""
    return lay_out_hashed(uplift_base(spark, sf_dir), "id", 3).running().select("id", F.col("k").alias("place"))


@query(
    "hash_split_3way",
    f"""WITH {BASE_SQL}, h AS (SELECT id, label, {hash01_sql('id', '2')} AS h FROM base)
SELECT CASE WHEN h < 0.64 THEN 'train' WHEN h < 0.8 THEN 'valid' ELSE 'test' END AS split,
       COUNT(*) AS n, SUM(label)::BIGINT AS labels, SUM(id)::BIGINT AS ids
FROM h GROUP BY 1""",
)
def hash_split_3way(spark, sf_dir):
    rows = sampling.assign_split(uplift_base(spark, sf_dir), "id", 2)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), F.sum("id").alias("ids")
    )


@query(
    "hash_split_2way",
    f"""WITH {BASE_SQL}
SELECT id, CASE WHEN {hash01_sql('id', '2')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM base""",
)
def hash_split_2way(spark, sf_dir):
    rows = sampling.assign_split(uplift_base(spark, sf_dir), "id", 2, sampling.TWO_WAY)
    return rows.select("id", "split")


@query(
    "user_kfold",
    f"""WITH {BASE_SQL}
SELECT CAST({hash_sql('userid', '4')} % 4 AS INT) AS fold, COUNT(*) AS n,
       COUNT(DISTINCT userid) AS users FROM base GROUP BY 1""",
)
def user_kfold(spark, sf_dir):
    rows = sampling.user_folds(uplift_base(spark, sf_dir), "userid", 4, 4)
    return rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("userid").alias("users")
    )


@query(
    "user_kfold_exact",
    f"""WITH {BASE_SQL},
folds AS (SELECT userid, NTILE(4) OVER (ORDER BY {hash_sql('userid', '4')}, userid) - 1 AS fold
          FROM (SELECT DISTINCT userid FROM base))
SELECT b.id, CAST(f.fold AS INT) AS fold FROM base b JOIN folds f ON f.userid = b.userid""",
)
def user_kfold_exact(spark, sf_dir):
    rows = sampling.user_folds(uplift_base(spark, sf_dir), "userid", 4, 4, exact=True)
    return rows.select("id", "fold")


@query(
    "uplift_cumlift",
    f"""WITH {RANKED_SQL}
SELECT arm, k, {r('lift', 8, 'value')},
       {r('CASE WHEN k = 0 THEN 0.0 ELSE lift_n END', 8, 'random')} FROM curve""",
)
def uplift_cumlift(spark, sf_dir):
    curve = curves.uplift_curve(scored(spark, sf_dir), "lift", keep_random=True)
    return curve.select("arm", "k", rnd("value", 8), rnd("random", 8))


@query(
    "uplift_gain",
    f"""WITH {RANKED_SQL}
SELECT arm, k, {r('k * lift / NULLIF(ABS(n * lift_n), 0)', 8, 'value')} FROM curve""",
)
def uplift_gain(spark, sf_dir):
    curve = curves.uplift_curve(scored(spark, sf_dir), "gain", normalize=True)
    return curve.select("arm", "k", rnd("value", 8))


@query(
    "qini_curve",
    f"""WITH {RANKED_SQL}
SELECT arm, k, {r('qini', 8, 'value')}, {r('qini_n * k / n', 8, 'random')} FROM curve""",
)
def qini_curve(spark, sf_dir):
    curve = curves.uplift_curve(scored(spark, sf_dir), "qini", keep_random=True)
    return curve.select("arm", "k", rnd("value", 8), rnd("random", 8))


@query(
    "uplift_auuc",
    f"""WITH {RANKED_SQL}
SELECT arm, MAX(n) AS n, {r('SUM(k * lift / NULLIF(ABS(n * lift_n), 0)) / (MAX(n) + 1)', 8, 'auuc')}
FROM curve GROUP BY arm""",
)
def uplift_auuc(spark, sf_dir):
    return curves.auuc(scored(spark, sf_dir)).select("arm", "n", rnd("auuc", 8))


@query(
    "uplift_auuc_raw",
    f"""WITH {RANKED_SQL}
SELECT arm, {r('SUM(k * lift) / (MAX(n) + 1)', 6, 'auuc')},
       {r('MAX(n * lift_n) / 2', 6, 'random')} FROM curve GROUP BY arm""",
)
def uplift_auuc_raw(spark, sf_dir):
    areas = curves.auuc(scored(spark, sf_dir), normalize=False)
    return areas.select("arm", rnd("auuc", 6), rnd("random", 6))


@query(
    "uplift_auuc_lift",
    f"""WITH {RANKED_SQL}
SELECT arm, {r('(SUM(k * lift) / (MAX(n) + 1) - MAX(n * lift_n) / 2) / NULLIF(MAX(ABS(n * lift_n)), 0)', 8, 'lift')}
FROM curve GROUP BY arm""",
)
def uplift_auuc_lift(spark, sf_dir):
    return curves.auuc_over_random(scored(spark, sf_dir)).select("arm", rnd("lift", 8))


@query(
    "qini_score",
    f"""WITH {RANKED_SQL}
SELECT arm, {r('(SUM(qini) / (MAX(n) + 1) - MAX(qini_n) / 2) / NULLIF(MAX(ABS(qini_n)), 0)', 8, 'qini')}
FROM curve GROUP BY arm""",
)
def qini_score(spark, sf_dir):
    return curves.qini_score(scored(spark, sf_dir)).select("arm", rnd("qini", 8))


@query(
    "uplift_topn_lift",
    f"""WITH {RANKED_SQL}
SELECT arm, k, {r('lift', 8, 'lift')} FROM curve WHERE k = LEAST(1000, n)""",
)
def uplift_topn_lift(spark, sf_dir):
    return curves.top_n_lift(scored(spark, sf_dir), 1000).select("arm", "k", rnd("lift", 8))


REPEATED_SQL = f"""WITH {LONG_SQL},
seeds AS (SELECT CAST(UNNEST(range(50)) AS INT) AS seed),
drawn AS (
  SELECT l.*, s.seed,
         ROW_NUMBER() OVER (PARTITION BY l.arm, s.seed, l.treatment
                            ORDER BY {hash_sql('l.id', 's.seed')}, l.id) AS pos
  FROM long l, seeds s),
sizes AS (SELECT arm, MIN(n) AS keep
          FROM (SELECT arm, treatment, COUNT(*) AS n FROM long GROUP BY ALL) GROUP BY arm),
picked AS (SELECT d.* FROM drawn d JOIN sizes z ON z.arm = d.arm WHERE d.pos <= z.keep),
ranked AS (
  SELECT arm, seed, k, SUM(treatment) OVER w AS n_t, SUM(1 - treatment) OVER w AS n_c,
         SUM(treatment * label) OVER w AS y_t, SUM((1 - treatment) * label) OVER w AS y_c
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm, seed ORDER BY {ORDER_SQL}) AS k FROM picked)
  WINDOW w AS (PARTITION BY arm, seed ORDER BY k ROWS UNBOUNDED PRECEDING)),
raw AS (
  SELECT *, CASE WHEN n_t > 0 AND n_c > 0
                 THEN CAST(y_t AS DOUBLE) / n_t - CAST(y_c AS DOUBLE) / n_c END AS lift FROM ranked),
firsts AS (
  SELECT arm, seed, MIN(k) FILTER (lift IS NOT NULL) AS m,
         ARG_MIN(lift, k) FILTER (lift IS NOT NULL) AS lift_m,
         MAX(k) AS n, ARG_MAX(lift, k) AS lift_n FROM raw GROUP BY arm, seed),
scores AS (
  SELECT r.arm, r.seed,
         (SUM(r.k * COALESCE(r.lift, f.lift_m * r.k / f.m)) / (MAX(f.n) + 1)
          - MAX(f.n * f.lift_n) / 2) / NULLIF(MAX(ABS(f.n * f.lift_n)), 0) AS lift
  FROM raw r JOIN firsts f ON f.arm = r.arm AND f.seed = r.seed GROUP BY r.arm, r.seed)
"""


@query("uplift_auuc_repeated", REPEATED_SQL + f"SELECT arm, seed, {r('lift', 7, 'lift')} FROM scores")
def uplift_auuc_repeated(spark, sf_dir):
    return curves.auuc_repeated(scored(spark, sf_dir)).select("arm", "seed", rnd("lift", 7))


@query(
    "uplift_auuc_mean",
    REPEATED_SQL
    + f"SELECT arm, COUNT(*) AS samples, {r('AVG(lift)', 7, 'lift')} FROM scores GROUP BY arm",
)
def uplift_auuc_mean(spark, sf_dir):
    return curves.auuc_mean(scored(spark, sf_dir)).select("arm", "samples", rnd("lift", 7))


@query(
    "uplift_scores_wide",
    f"""WITH {LONG_SQL}
SELECT id, """
    + ", ".join(r(f"MAX(uplift) FILTER (arm = {a})", 9, f"uplift_{a}") for a in arms.ARMS)
    + " FROM long GROUP BY id",
)
def uplift_scores_wide(spark, sf_dir):
    wide = arms.arms_wide(scored(spark, sf_dir))
    return wide.select("id", *[rnd(f"uplift_{a}", 9) for a in arms.ARMS])


@query(
    "split_gather_by_arm",
    f"""WITH {BASE_SQL}
SELECT id, treatment, label * 100 + treatment AS outcome FROM base""",
)
def split_gather_by_arm(spark, sf_dir):
    rows = arms.map_arms(
        uplift_base(spark, sf_dir).select("id", "treatment", "label"),
        [0, *arms.ARMS],
        lambda part, arm: part.withColumn("outcome", F.col("label") * 100 + F.lit(arm)),
    )
    return rows.select("id", "treatment", "outcome")


@query(
    "treated_control_counts",
    f"""WITH {BASE_SQL}
SELECT CASE WHEN treatment > 0 THEN 'treated' ELSE 'control' END AS side, COUNT(*) AS n,
       SUM(label)::BIGINT AS labels FROM base GROUP BY 1""",
)
def treated_control_counts(spark, sf_dir):
    return arms.mark_treated(uplift_base(spark, sf_dir)).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels")
    )
