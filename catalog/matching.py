"""Queries over propensity scores, feature ranking, balance and model errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.fixtures import (
    BASE_SQL,
    DAILY_SQL,
    FEATURES,
    PSM_SQL,
    REP_SQL,
    SAMPLE_SQL,
    gmv,
    hash01_sql,
    hash_sql,
    psm_score,
    r,
    rep_sample,
    uplift_base,
    uplift_sample,
)
from catalog.registry import day, query, rnd
from cohortcast.functions.hashing import hash01
from cohortcast.operators import balance, boosting, feature_rank, frames, learners, matching, metrics, series, splits
from cohortcast.operators.arms import ARMS
from cohortcast.session import stage

SCORES = [f"ps_score_{a}" for a in ARMS]


# ---- matching ----------------------------------------------------------------------------------


def gap_sql(scores) -> str:
    total = " + ".join(f"(t.{s} - c.{s}) * (t.{s} - c.{s})" for s in scores)
    return f"ROUND(SQRT({total}), 12)"


def match_sql(scores, treated: str, controls: str, counted: str = "", buffer: float = 1.0) -> str:
    """CTEs from two tables to ``kept``; the distinct treated vectors find the same controls."""
    names = ", ".join(scores)
    return f"""
asking AS (SELECT DISTINCT treatment AS arm, {names} FROM {treated}),
numbered AS (SELECT *, ROW_NUMBER() OVER () AS q FROM asking),
pairs AS (SELECT t.arm, t.q, c.id, {hash_sql('c.id')} AS tie, {gap_sql(scores)} AS distance
          FROM numbered t, {controls} c),
near AS (SELECT * FROM pairs QUALIFY ROW_NUMBER() OVER (PARTITION BY q ORDER BY distance, tie, id) <= 2),
closest AS (SELECT arm, id, tie, MIN(distance) AS distance FROM near GROUP BY ALL),
sizes AS (SELECT treatment AS arm, round_even(COUNT(*) * {buffer}, 0) AS n FROM {counted or treated} GROUP BY 1),
kept AS (
  SELECT c.arm, c.id, c.distance FROM closest c JOIN sizes s ON s.arm = c.arm
  QUALIFY ROW_NUMBER() OVER (PARTITION BY c.arm ORDER BY c.distance, c.tie, c.id) <= MAX(s.n) OVER (PARTITION BY c.arm))"""


def split_scores(spark, sf_dir):
    rows = psm_score(spark, sf_dir)
    treated = rows.filter("treatment > 0").withColumnRenamed("treatment", "arm")
    controls = rows.filter("treatment = 0 and rct_mark = 0")
    return treated, controls


def sides_sql(scores, rows: str = "psm") -> str:
    """Both sides; rows with a missing score count for the size of their arm only."""
    present = " AND ".join(f"{s} IS NOT NULL" for s in scores)
    return f"""
sides AS (SELECT * FROM {rows} WHERE treatment > 0),
treated AS (SELECT * FROM sides WHERE {present}),
controls AS (SELECT * FROM {rows} WHERE treatment = 0 AND rct_mark = 0 AND {present})"""


# Fixed value: half as many controls as treated rows, so that the closest are selected.
BUFFER = 0.5


@query(
    "psm_match",
    f"""WITH {PSM_SQL}, {sides_sql(SCORES)}, {match_sql(SCORES, 'treated', 'controls', 'sides', BUFFER)}
SELECT arm, id, {r('distance', 9, 'distance')} FROM kept""",
)
def psm_match(spark, sf_dir):
    """Eight independent scores, some of them missing."""
    matches = matching.match_controls(*split_scores(spark, sf_dir), SCORES, BUFFER)
    return matches.select("arm", "id", rnd("distance", 9))


@query(
    "psm_match_one_score",
    f"""WITH {PSM_SQL}, {sides_sql(SCORES[:1])}, {match_sql(SCORES[:1], 'treated', 'controls', 'sides', BUFFER)}
SELECT arm, id, {r('distance', 9, 'distance')} FROM kept""",
)
def psm_match_one_score(spark, sf_dir):
    matches = matching.match_controls(*split_scores(spark, sf_dir), SCORES[:1], BUFFER, cell_rows=64)
    return matches.select("arm", "id", rnd("distance", 9))


@query(
    "psm_matched_ids",
    f"""WITH {PSM_SQL}, {sides_sql(SCORES)}, {match_sql(SCORES, 'treated', 'controls', 'sides', BUFFER)}
SELECT DISTINCT id FROM kept""",
)
def psm_matched_ids(spark, sf_dir):
    matches = matching.match_controls(*split_scores(spark, sf_dir), SCORES, BUFFER, cell_rows=64)
    return matching.matched_ids(matches)


def _own_scores(sql: bool):
    """Three scores that have nothing to do with each other, a few of them missing."""
    parts = {}
    for k in (1, 2, 3):
        if sql:
            parts[f"s{k}"] = f"CASE WHEN id % 97 <> {k} THEN {hash01_sql('id', str(60 + k))} END AS s{k}"
        else:
            parts[f"s{k}"] = F.when(F.col("id") % 97 != k, hash01("id", 60 + k))
    return ", ".join(parts.values()) if sql else parts


@query(
    "psm_match_buffer",
    f"""WITH {BASE_SQL}, scored AS (SELECT *, {_own_scores(True)} FROM base),
sides AS (SELECT * FROM scored WHERE treatment > 0),
treated AS (SELECT * FROM sides WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL),
controls AS (SELECT * FROM scored WHERE treatment = 0 AND rct_mark = 0
             AND s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL),
{match_sql(["s1", "s2", "s3"], 'treated', 'controls', 'sides', 0.3)}
SELECT arm, id, {r('distance', 9, 'distance')} FROM kept""",
)
def psm_match_buffer(spark, sf_dir):
    """Independent scores with missing ones; the buffer keeps fewer controls than were found."""
    rows = uplift_base(spark, sf_dir).withColumns(_own_scores(False))
    treated = rows.filter("treatment > 0").withColumnRenamed("treatment", "arm")
    controls = rows.filter("treatment = 0 and rct_mark = 0")
    matches = matching.match_controls(treated, controls, ["s1", "s2", "s3"], 0.3, cell_rows=64)
    return matches.select("arm", "id", rnd("distance", 9))


EVAL_SQL = f"""
picked AS (
  SELECT id, userid, treatment FROM base WHERE rct_mark = 1 AND treatment > 0
  UNION ALL
  (SELECT id, userid, treatment FROM base WHERE rct_mark = 0 AND treatment = 0
   QUALIFY ROW_NUMBER() OVER (ORDER BY {hash_sql('id')}, id)
           <= (SELECT COUNT(*) FROM base WHERE rct_mark = 1 AND treatment > 0)))"""


@query(
    "psm_eval_sample",
    f"""WITH {BASE_SQL}
SELECT id, treatment FROM base WHERE rct_mark = 1 AND treatment > 0
UNION ALL
(SELECT id, treatment FROM base WHERE rct_mark = 0 AND treatment = 0
 QUALIFY ROW_NUMBER() OVER (ORDER BY {hash_sql('id')}, id)
         <= (SELECT COUNT(*) // 2 FROM base WHERE rct_mark = 0 AND treatment = 0))""",
)
def psm_eval_sample(spark, sf_dir):
    """The draw stops at half of the observed controls, fewer than there are treated rows."""
    rows = matching.evaluation_sample(uplift_base(spark, sf_dir), control_share=0.5)
    return rows.select("id", "treatment")


@query(
    "anti_join_users",
    f"""WITH {BASE_SQL}, {EVAL_SQL}
SELECT id, userid FROM base WHERE userid NOT IN (SELECT userid FROM picked)""",
)
def anti_join_users(spark, sf_dir):
    rows = uplift_base(spark, sf_dir)
    kept = matching.training_rows(rows, matching.evaluation_sample(rows))
    return kept.select("id", "userid")


# Fixed value: a small evaluation share, so that controls remain for training.
SHARE_SQL = f"""
drawn AS (SELECT DISTINCT userid FROM base WHERE {hash01_sql('userid', '8')} < 0.1),
rest AS (SELECT * FROM psm WHERE userid NOT IN (SELECT userid FROM drawn)), {sides_sql(SCORES, 'rest')}"""


@query(
    "psm_train_sample",
    f"""WITH {PSM_SQL}, {SHARE_SQL}, {match_sql(SCORES, 'treated', 'controls', 'sides', BUFFER)}
SELECT id, treatment FROM sides
UNION ALL SELECT id, treatment FROM controls WHERE id IN (SELECT id FROM kept)""",
)
def psm_train_sample(spark, sf_dir):
    rows = psm_score(spark, sf_dir)
    drawn = rows.filter(hash01("userid", 8) < 0.1)
    rest = matching.training_rows(rows, drawn)
    return matching.matched_training_sample(rest, SCORES, buffer=BUFFER).select("id", "treatment")


# ---- imputation and feature ranking ------------------------------------------------------------

FILLED_SQL = (
    SAMPLE_SQL
    + """,
filled AS (
  SELECT id, userid, treatment, label, rct_mark, """
    + ", ".join(f"COALESCE({f}, AVG({f}) OVER ()) AS {f}" for f in FEATURES)
    + " FROM sample)"
)


@query(
    "fill_mean",
    f"WITH {FILLED_SQL} SELECT id, " + ", ".join(r(f, 6, f) for f in FEATURES) + " FROM filled",
)
def fill_mean(spark, sf_dir):
    rows = frames.fill_means(uplift_sample(spark, sf_dir), FEATURES)
    return rows.select("id", *[rnd(f, 6) for f in FEATURES])


def corr_sql(f: str, i: int) -> str:
    return f"ABS(CORR({f}, treatment) FILTER ({hash01_sql('id', str(i))} < 0.66))"


@query(
    "corr_rank",
    f"WITH {FILLED_SQL}, scores AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, ({' + '.join(corr_sql(f, i) for i in range(3))}) / 3 AS score FROM filled"
        for f in FEATURES
    )
    + f""")
SELECT feature, {r('score', 8, 'score')},
       CAST(ROW_NUMBER() OVER (ORDER BY score DESC, feature) AS INT) AS place FROM scores""",
)
def corr_rank(spark, sf_dir):
    rows = frames.fill_means(uplift_sample(spark, sf_dir), FEATURES)
    ranked = feature_rank.correlation_rank(rows, FEATURES)
    return ranked.select("feature", rnd("score", 8), "place")


def slope_sql(f: str) -> str:
    def part(fn: str, arm: int) -> str:
        return f"REGR_{fn}(label, {f}) FILTER (treatment = {arm})"

    return f"""SELECT '{f}' AS feature, {part('SXX', 3)} AS xt, {part('SYY', 3)} AS yt, {part('SXY', 3)} AS pt,
  {part('SXX', 0)} AS xc, {part('SYY', 0)} AS yc, {part('SXY', 0)} AS pc,
  COUNT({f}) AS n FROM sample WHERE treatment IN (0, 3)"""


#: Tail of Student's t distribution with ``freedom`` degrees on both sides of z, by Simpson's rule.
T_TAIL_SQL = (
    "1 - 2 * z / 2000 / 3 * EXP(LGAMMA((freedom + 1) / 2.0) - LGAMMA(freedom / 2.0)) / SQRT(freedom * PI()) * "
    "list_sum(list_transform(range(2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END "
    "* POWER(1 + (z * k / 2000) ** 2 / freedom, -0.5 * (freedom + 1))))"
)


@query(
    "filter_f",
    f"WITH {SAMPLE_SQL}, parts AS ("
    + " UNION ALL ".join(slope_sql(f) for f in FEATURES)
    + f"""),
scored AS (SELECT feature, CAST(n - 4 AS BIGINT) AS freedom, POWER(pt / xt - pc / xc, 2)
  / (((yt - pt * pt / xt) + (yc - pc * pc / xc)) / (n - 4) * (1 / xt + 1 / xc)) AS raw FROM parts),
tails AS (SELECT *, SQRT(raw) AS z FROM scored)
SELECT feature, freedom, {r('raw', 6, 'score')}, {r(T_TAIL_SQL, 5, 'p_value')},
  ROW_NUMBER() OVER (ORDER BY raw DESC NULLS LAST, feature) AS place FROM tails""",
)
def filter_f(spark, sf_dir):
    ranked = feature_rank.interaction_f(uplift_sample(spark, sf_dir), FEATURES, treated=3)
    return ranked.select("feature", "freedom", rnd("score", 6), rnd("p_value", 5), F.col("place").cast("long").alias("place"))


def divergence_sql(method: str) -> str:
    divergence = {
        "KL": "p * LN(p / q) + (1 - p) * LN((1 - p) / (1 - q))",
        "ED": "2 * (p - q) * (p - q)",
        "Chi": "(p - q) * (p - q) / GREATEST(1e-6, q) + (p - q) * (p - q) / GREATEST(1e-6, 1 - q)",
    }[method]
    quantiles = [i / 10 for i in range(1, 10)]
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, treatment, label, {f} AS x FROM sample WHERE treatment IN (0, 3)"
        for f in FEATURES
    )

    def node(keys: str) -> str:
        return f"""SELECT {keys}, SUM(n) AS n,
  MAX(y1) FILTER (treatment = 3) AS a1, MAX(y0) FILTER (treatment = 3) AS a0,
  MAX(y1) FILTER (treatment = 0) AS b1, MAX(y0) FILTER (treatment = 0) AS b0
  FROM (SELECT {keys}, treatment, COUNT(*) AS n, SUM(label) AS y1, SUM(1 - label) AS y0
        FROM binned GROUP BY {keys}, treatment) GROUP BY {keys}"""

    rates = """CAST(GREATEST(a1, 1) AS DOUBLE) / (GREATEST(a1, 1) + GREATEST(a0, 1)) AS p,
  LEAST(GREATEST(CAST(GREATEST(b1, 1) AS DOUBLE) / (GREATEST(b1, 1) + GREATEST(b0, 1)), 1e-6), 1 - 1e-6) AS q"""
    return f"""WITH {SAMPLE_SQL}, tall AS ({long}),
cuts AS (SELECT feature, list_distinct(QUANTILE_CONT(x, {quantiles})) AS cut FROM tall GROUP BY feature),
binned AS (SELECT t.feature, t.treatment, t.label, len(list_filter(c.cut, lambda v: t.x > v)) AS bin
           FROM tall t JOIN cuts c ON c.feature = t.feature WHERE t.x IS NOT NULL),
leaves AS (SELECT feature, n, {rates} FROM ({node('feature, bin')})),
roots AS (SELECT feature, {rates} FROM ({node('feature')})),
scores AS (SELECT feature, SUM(n * COALESCE({divergence}, 0.0)) / SUM(n) AS score FROM leaves GROUP BY feature)
SELECT s.feature, {r('s.score', 8, 'score')}, {r(divergence, 8, 'parent')},
       CAST(ROW_NUMBER() OVER (ORDER BY s.score DESC, s.feature) AS INT) AS place
FROM scores s JOIN roots ON roots.feature = s.feature"""


def divergence(spark, sf_dir, method):
    ranked = feature_rank.divergence_rank(
        uplift_sample(spark, sf_dir), FEATURES, method, treated=3
    )
    return ranked.select("feature", rnd("score", 8), rnd("parent", 8), "place")


@query("filter_kl", divergence_sql("KL"))
def filter_kl(spark, sf_dir):
    return divergence(spark, sf_dir, "KL")


@query("filter_ed", divergence_sql("ED"))
def filter_ed(spark, sf_dir):
    return divergence(spark, sf_dir, "ED")


@query("filter_chi", divergence_sql("Chi"))
def filter_chi(spark, sf_dir):
    return divergence(spark, sf_dir, "Chi")


NEWTON_STEPS = 8
#: Tail of the standard normal distribution on both sides of z, by Simpson's rule.
TAIL_SQL = (
    "1 - 2 * z / 2000 / 3 / SQRT(2 * PI()) * list_sum(list_transform(range(2001), lambda k: "
    "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * EXP(-0.5 * (z * k / 2000) ** 2)))"
)


def newton_sql(name: str, terms: list[str]) -> str:
    """CTEs of a logistic model of every feature at once: Newton steps by Gaussian elimination."""
    n = range(len(terms))
    eta = " + ".join(f"b{i} * {z}" for i, z in enumerate(terms))
    parts = [f"{name}_b0 AS (SELECT DISTINCT feature, {', '.join(f'0.0::DOUBLE AS b{i}' for i in n)} FROM scaled)"]
    for step in range(1, NEWTON_STEPS + 1):
        sums = [f"SUM((y - p) * {terms[i]}) AS g{i}" for i in n]
        sums += [f"SUM(p * (1 - p) * {terms[i]} * {terms[j]}) AS h{i}{j}" for i in n for j in n]
        parts.append(f"""{name}_s{step}_0 AS MATERIALIZED (SELECT feature, {', '.join(sums)}
  FROM (SELECT s.*, 1 / (1 + EXP(-({eta}))) AS p FROM scaled s JOIN {name}_b{step - 1} USING (feature)) GROUP BY feature)""")
        for k in n[:-1]:
            cells = [f"h{i}{j} - h{i}{k} * h{k}{j} / h{k}{k} AS h{i}{j}" if i > k else f"h{i}{j}" for i in n for j in n]
            cells += [f"g{i} - h{i}{k} * g{k} / h{k}{k} AS g{i}" if i > k else f"g{i}" for i in n]
            parts.append(f"{name}_s{step}_{k + 1} AS MATERIALIZED (SELECT feature, {', '.join(cells)} FROM {name}_s{step}_{k})")
        solved = []
        for i in reversed(n):
            later = "".join(f" - h{i}{j} * d{j}" for j in n if j > i)
            solved.append(f"(g{i}{later}) / h{i}{i} AS d{i}")
        parts.append(f"{name}_d{step} AS MATERIALIZED (SELECT feature, {', '.join(solved)} FROM {name}_s{step}_{len(terms) - 1})")
        parts.append(f"{name}_b{step} AS MATERIALIZED (SELECT feature, {', '.join(f'b{i} + d{i} AS b{i}' for i in n)} FROM {name}_b{step - 1} JOIN {name}_d{step} USING (feature))")
    parts.append(f"{name} AS (SELECT feature, SUM(y * ({eta}) - LN(1 + EXP({eta}))) AS ll FROM scaled JOIN {name}_b{NEWTON_STEPS} USING (feature) GROUP BY feature)")
    return ",\n".join(parts)


LR_SQL = f"""WITH {SAMPLE_SQL},
long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, label::DOUBLE AS y, (treatment = 3)::INT AS t, {f}::DOUBLE AS raw FROM sample WHERE treatment IN (0, 3) AND {f} IS NOT NULL" for f in FEATURES)}),
scaled AS MATERIALIZED (SELECT feature, y, t, (raw - AVG(raw) OVER (PARTITION BY feature)) / STDDEV_POP(raw) OVER (PARTITION BY feature) AS x FROM long),
{newton_sql('small', ['1', 't', 'x'])},
{newton_sql('large', ['1', 't', 'x', 't * x'])},
scores AS (SELECT feature, 2 * (l.ll - s.ll) AS raw FROM small s JOIN large l USING (feature)),
tails AS (SELECT *, SQRT(GREATEST(raw, 0)) AS z FROM scores)
SELECT feature, {r('raw', 4, 'score')}, {r(TAIL_SQL, 4, 'p_value')},
       CAST(ROW_NUMBER() OVER (ORDER BY raw DESC, feature) AS INT) AS place FROM tails"""


@query("filter_lr", LR_SQL)
def filter_lr(spark, sf_dir):
    rows = uplift_sample(spark, sf_dir)
    ranked = feature_rank.likelihood_ratio(rows, FEATURES, treated=3)
    return ranked.select("feature", rnd("score", 4), rnd("p_value", 4), "place")


# ---- balance -----------------------------------------------------------------------------------

MEANS_SQL = f"""WITH {REP_SQL},
parts AS (SELECT t, CAST(UNNEST(x) AS DOUBLE) AS v, UNNEST(range(1, len(x) + 1)) AS i FROM rep),
means AS (SELECT i, AVG(v) FILTER (t = 1) AS a, AVG(v) FILTER (t = 0) AS b FROM parts GROUP BY i)"""


@query(
    "mmd_linear",
    MEANS_SQL + f" SELECT {r('2 * SQRT(SUM((a - b) * (a - b)))', 8, 'distance')} FROM means",
)
def mmd_linear(spark, sf_dir):
    return balance.mmd(rep_sample(spark, sf_dir)).select(rnd("distance", 8))


@query(
    "mean_distance",
    MEANS_SQL + f" SELECT {r('SQRT(SUM((a - b) * (a - b)))', 8, 'distance')} FROM means",
)
def mean_distance(spark, sf_dir):
    return balance.mean_distance(rep_sample(spark, sf_dir)).select(rnd("distance", 8))


def transport_sql(batch_rows: int) -> str:
    """The transport distance per batch, one pair of CTEs per step."""
    steps, last = [], "u0"
    for i in range(10):
        steps.append(
            f"""w{i} AS (SELECT k.batch, k.j, ANY_VALUE(k.b) / SUM(k.kern * u.u) AS w
  FROM kern k JOIN {last} u ON u.batch = k.batch AND u.i = k.i GROUP BY k.batch, k.j),
u{i + 1} AS (SELECT k.batch, k.i, 1 / SUM(k.kern / k.a * w.w) AS u
  FROM kern k JOIN w{i} w ON w.batch = k.batch AND w.j = k.j GROUP BY k.batch, k.i)"""
        )
        last = f"u{i + 1}"
    return f"""WITH {REP_SQL},
placed AS (SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY {hash_sql('id')}, id) - 1) // {batch_rows} AS BIGINT) AS batch
           FROM rep),
sizes AS (SELECT batch, SUM(t)::BIGINT AS n_treated, SUM(1 - t)::BIGINT AS n_control FROM placed GROUP BY batch),
costs AS MATERIALIZED (
  SELECT p.batch, p.id AS i, q.id AS j,
         POWER(list_distance(CAST(p.x AS DOUBLE[]), CAST(q.x AS DOUBLE[])), 2) AS cost
  FROM placed p JOIN placed q ON q.batch = p.batch AND p.t = 1 AND q.t = 0),
kern AS MATERIALIZED (
  SELECT c.*, EXP(MIN(cost) OVER (PARTITION BY c.batch, c.i) - cost) AS kern,
         0.5 / s.n_treated AS a, 0.5 / s.n_control AS b
  FROM costs c JOIN sizes s ON s.batch = c.batch),
u0 AS (SELECT DISTINCT batch, i, a AS u FROM kern),
{', '.join(steps)},
v AS (SELECT k.batch, k.j, ANY_VALUE(k.b) / SUM(k.kern * u.u) AS v
      FROM kern k JOIN {last} u ON u.batch = k.batch AND u.i = k.i GROUP BY k.batch, k.j),
totals AS (SELECT k.batch, 2 * SUM(u.u * v.v * k.kern * k.cost) AS distance
  FROM kern k JOIN {last} u ON u.batch = k.batch AND u.i = k.i JOIN v ON v.batch = k.batch AND v.j = k.j
  GROUP BY k.batch)
SELECT s.batch, s.n_treated, s.n_control, {r('COALESCE(t.distance, 0)', 6, 'distance')}
FROM sizes s LEFT JOIN totals t ON t.batch = s.batch"""


@query("sinkhorn_by_batch", transport_sql(100))
def sinkhorn_by_batch(spark, sf_dir):
    rows = balance.batch_transport(rep_sample(spark, sf_dir), batch_rows=100)
    return rows.select("batch", "n_treated", "n_control", rnd("distance", 6))


LOGIT_SQL = f"(2 * {hash01_sql('id', '6')} - 1)"


@query(
    "balanced_loss",
    MEANS_SQL
    + f""",
loss AS (SELECT AVG(LN(1 + EXP({LOGIT_SQL})) - y * {LOGIT_SQL}) AS pred_loss FROM rep),
term AS (SELECT 2 * SQRT(SUM((a - b) * (a - b))) AS ipm_loss FROM means)
SELECT {r('pred_loss', 8, 'pred_loss')}, {r('ipm_loss', 8, 'ipm_loss')},
       {r('pred_loss + ipm_loss', 8, 'total_loss')} FROM loss, term""",
)
def balanced_loss(spark, sf_dir):
    rows = rep_sample(spark, sf_dir).withColumn("logit", 2 * hash01("id", 6) - 1)
    report = balance.balanced_loss(rows, "logit", "y", use_ipm=True, ipm="mmd")
    return report.select(rnd("pred_loss", 8), rnd("ipm_loss", 8), rnd("total_loss", 8))


# ---- errors ------------------------------------------------------------------------------------

P_SQL = "CAST((id * 37) % 499 AS DOUBLE) / 499"


def predicted(spark, sf_dir):
    p = ((F.col("id") * 37) % 499).cast("double") / F.lit(499.0)
    return uplift_base(spark, sf_dir).withColumn("p", p)


@query(
    "classification_report",
    f"""WITH {BASE_SQL}, scored AS (
  SELECT label AS y, {P_SQL} AS p, LEAST(GREATEST({P_SQL}, 1e-15), 1 - 1e-15) AS q FROM base),
per_score AS (SELECT p, SUM(y) AS pos, SUM(1 - y) AS neg FROM scored GROUP BY p),
below AS (SELECT *, SUM(neg) OVER (ORDER BY p) - neg AS under FROM per_score),
area AS (SELECT SUM(pos * (under + neg / 2.0)) / (SUM(pos) * SUM(neg)) AS auc FROM below)
SELECT COUNT(*) AS n, {r('AVG(-(y * LN(q) + (1 - y) * LN(1 - q)))', 8, 'logloss')},
       {r('AVG(CAST(CAST(p > 0.5 AS INT) = y AS INT))', 8, 'accuracy')}, {r('ANY_VALUE(auc)', 8, 'auc')}
FROM scored, area""",
)
def classification_report(spark, sf_dir):
    report = metrics.classification_report(predicted(spark, sf_dir), "p", "label")
    return report.select("n", rnd("logloss", 8), rnd("accuracy", 8), rnd("auc", 8))


@query(
    "treatment_head_loss",
    f"""WITH {BASE_SQL}
SELECT {r(f'SUM(POWER({P_SQL} - CAST(treatment > 0 AS INT), 2))', 6, 't_loss')} FROM base""",
)
def treatment_head_loss(spark, sf_dir):
    rows = predicted(spark, sf_dir).withColumn("t", (F.col("treatment") > 0).cast("int"))
    return metrics.treatment_head_loss(rows, "p").select(rnd("t_loss", 6))


FORECAST_SQL = (
    DAILY_SQL
    + """,
forecast AS (SELECT dt, label, LAG(label, 7) OVER (ORDER BY dt) AS y_pred,
                    CAST((SELECT MAX(dt) FROM daily) - dt AS INT) AS age FROM daily)"""
)


def forecast(spark, sf_dir):
    """Daily sales with the value seven rows earlier as the prediction."""
    rows = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    w = Window.orderBy("dt")
    _, last = splits.series_span(rows)
    return rows.withColumns(
        {"y_pred": F.lag("label", 7).over(w), "age": F.datediff(F.lit(last), "dt")}
    )


@query(
    "percentage_error",
    f"""WITH {FORECAST_SQL}
SELECT CAST(dt AS VARCHAR) AS dt, {r('(y_pred - label) / NULLIF(label, 0)', 8, 'pe')},
       CAST(ROW_NUMBER() OVER (ORDER BY dt) AS INT) AS nex_n_day FROM forecast""",
)
def percentage_error(spark, sf_dir):
    rows = metrics.percentage_errors(forecast(spark, sf_dir))
    return rows.select(day("dt"), rnd("pe", 8), "nex_n_day")


@query(
    "forecast_errors",
    f"""WITH {FORECAST_SQL},
errors AS (SELECT (y_pred - label) / NULLIF(label, 0) AS pe FROM forecast WHERE y_pred IS NOT NULL)
SELECT {r('AVG(pe)', 8, 'pe_mean')}, {r('AVG(ABS(pe))', 8, 'ape_mean')} FROM errors""",
)
def forecast_errors(spark, sf_dir):
    rows = forecast(spark, sf_dir)
    report = metrics.forecast_errors(rows.select("dt", "y_pred"), rows.select("dt", "label"))
    return report.select(rnd("pe_mean", 8), rnd("ape_mean", 8))


#: Steps of the running forecast whose prefixes are judged.
STEPS = 30


def prefix_sql(criterion: str) -> str:
    loss = {"squared": "(label - p) * (label - p)", "relative": "ABS(label - p) / NULLIF(ABS(label), 0)"}[criterion]
    return f"""
each_{criterion} AS (
  SELECT CAST(k AS INT) AS iteration, AVG({loss}) AS loss
  FROM (SELECT label, UNNEST(range(1, {STEPS + 1})) AS k, UNNEST(prefixes) AS p FROM outputs) GROUP BY k),
least_{criterion} AS (SELECT *, MIN(loss) OVER (ORDER BY iteration) AS low FROM each_{criterion}),
since_{criterion} AS (
  SELECT *, iteration - (SELECT MIN(b.iteration) FROM least_{criterion} b WHERE b.loss = a.low) AS waited FROM least_{criterion} a),
kept_{criterion} AS (
  SELECT *, iteration <= COALESCE((SELECT MIN(iteration) FROM since_{criterion} WHERE waited >= 5), {STEPS}) AS used FROM since_{criterion}),
final_{criterion} AS (
  SELECT '{criterion}' AS criterion, iteration, loss, used,
         iteration = (SELECT MIN(iteration) FROM kept_{criterion} WHERE used AND loss = (SELECT MIN(loss) FROM kept_{criterion} WHERE used)) AS is_best
  FROM kept_{criterion})"""


@query(
    "best_iteration",
    f"""WITH {DAILY_SQL},
outputs AS (
  SELECT label, list_transform(range(1, {STEPS + 1}), lambda k: list_avg(lags[1:k])) AS prefixes
  FROM (SELECT label, LIST(label) OVER (ORDER BY dt ROWS BETWEEN {STEPS} PRECEDING AND 1 PRECEDING) AS lags FROM daily)
  WHERE len(lags) = {STEPS}),
{prefix_sql('squared')}, {prefix_sql('relative')}
SELECT criterion, iteration, {r('loss / CASE criterion WHEN $$squared$$ THEN 1e6 ELSE 1 END', 6, 'loss')}, is_best, used
FROM (SELECT * FROM final_squared UNION ALL SELECT * FROM final_relative)""",
)
def best_iteration(spark, sf_dir):
    """Staged outputs of 30 steps: which prefix predicts best, and where five steps without gain end it."""
    rows = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    before = Window.orderBy("dt").rowsBetween(-STEPS, -1)
    rows = rows.withColumn("lags", F.collect_list("label").over(before)).filter(F.size("lags") == STEPS)
    means = [F.aggregate(F.slice("lags", 1, k), F.lit(0.0), lambda a, x: a + x) / k for k in range(1, STEPS + 1)]
    outputs = stage(rows.select("label", F.array(*means).alias("prefixes")), "outputs")
    parts = [
        boosting.best_prefix(outputs, "prefixes", criterion=c, patience=5).select(
            F.lit(c).alias("criterion"), "iteration", rnd(F.col("loss") / (1e6 if c == "squared" else 1.0), 6, "loss"), "is_best", "used"
        )
        for c in ("squared", "relative")
    ]
    return parts[0].unionByName(parts[1])


ROUNDS = 6


@query(
    "recency_boost",
    f"""WITH {DAILY_SQL}, rows AS (SELECT COUNT(*) AS n FROM daily)
SELECT CAST(k AS INT) AS round, TRUE AS falls, TRUE AS as_metric, n FROM rows, (SELECT UNNEST(range(1, {ROUNDS + 1})) AS k)""",
)
def recency_boost(spark, sf_dir):
    """The recency-weighted loss falls with every round and is that of the staged predictions."""
    rows = forecast(spark, sf_dir).drop("y_pred").withColumns({"week": F.dayofweek("dt"), "month": F.month("dt")})
    rows = stage(learners.assemble(rows, ["age", "week", "month"]).select("label", "age", "features"), "boost_rows")
    fitted = boosting.recency_boost(rows, rows, rounds=ROUNDS, step=0.3, depth=4)
    scored = stage(rows.select("label", "age", fitted.prefixes().alias("prefixes")), "boost_scored")
    table, last = [], metrics.recency_weighted_loss(scored.withColumn("y_pred", F.lit(fitted.start))).first()["loss"]
    for k, loss in enumerate(fitted.losses, 1):
        own = metrics.recency_weighted_loss(scored.withColumn("y_pred", F.get("prefixes", F.lit(k - 1)))).first()["loss"]
        table.append((k, loss < last, abs(own - loss) <= 1e-9 * abs(loss)))
        last = loss
    checked = spark.createDataFrame(table, "round int, falls boolean, as_metric boolean")
    return checked.crossJoin(scored.agg(F.count(F.lit(1)).alias("n")))


@query(
    "wape",
    f"""WITH {FORECAST_SQL}
SELECT CAST(year(dt) AS INT) AS year, {r('SUM(ABS(y_pred - label)) / SUM(label)', 3, 'mape')}
FROM forecast WHERE y_pred IS NOT NULL GROUP BY 1""",
)
def wape(spark, sf_dir):
    rows = forecast(spark, sf_dir).na.drop("any").withColumn("year", F.year("dt"))
    return metrics.weighted_error(rows, groups=["year"])


@query(
    "weighted_l2",
    f"""WITH {FORECAST_SQL},
res AS (SELECT label - y_pred AS e, age <= 150 AS near FROM forecast WHERE y_pred IS NOT NULL),
share AS (SELECT ABS(SUM(e) FILTER (near)) / GREATEST(1, SUM(ABS(e)) FILTER (near)) AS s FROM res),
weight AS (SELECT 10 / (1 + EXP(-2 * s)) + 1 - 5 AS w FROM share)
SELECT {r('ANY_VALUE(w)', 8, 'weight')},
       {r('AVG(CASE WHEN near THEN e * e * w ELSE e * e END) / 1e6', 4, 'loss')}
FROM res, weight""",
)
def weighted_l2(spark, sf_dir):
    rows = forecast(spark, sf_dir).na.drop("any")
    report = metrics.recency_weighted_loss(rows)
    return report.select(rnd("weight", 8), rnd(F.col("loss") / 1e6, 4, "loss"))
