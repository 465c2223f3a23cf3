"""Bucketed ordering against the plain window, with hot ties and missing scores."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortcast.functions.hashing import hash_int
from cohortcast.operators import curves
from cohortcast.operators.ordering import (
    equal_bins,
    exact_quantiles,
    first_rows,
    lay_out,
    lay_out_hashed,
)
from cohortcast.operators.sampling import balance


@pytest.fixture(scope="module")
def scored(spark):
    """4,000 rows; a third share one score, a tenth have none, one group is much larger."""
    h = hash_int("id", 9)
    rows = spark.range(4000).select(
        "id",
        F.when(h % 10 < 7, "big").otherwise("small").alias("arm"),
        F.when(F.col("id") % 3 == 0, F.lit(0.25))
        .when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise((h % 101).cast("double") / 101.0)
        .alias("uplift"),
        (h % 2).cast("int").alias("treatment"),
        (h % 5 == 0).cast("int").alias("label"),
    )
    return rows.persist()


def ranks(df):
    order = [F.desc_nulls_last("uplift"), hash_int("id", 0), F.col("id")]
    return df.withColumn("want", F.row_number().over(Window.partitionBy("arm").orderBy(*order)))


def test_running_rank_equals_plain_window(scored):
    layout = lay_out(scored, "uplift", "id", ["arm"], rows_per_bucket=50)
    assert layout.n_buckets > 20
    got = layout.running(total=F.col("label")).select("id", "k", "total")
    want = ranks(scored).withColumn(
        "want_total", F.sum("label").over(Window.partitionBy("arm").orderBy("want"))
    )
    bad = got.join(want, "id").filter("k <> want or total <> want_total").count()
    assert got.count() == 4000 and bad == 0


def test_hot_score_is_split(scored):
    layout = lay_out(scored, "uplift", "id", ["arm"], rows_per_bucket=50)
    largest = layout.rows.groupBy(*layout.keys).count().agg(F.max("count")).first()[0]
    assert largest < 400


def test_bins_equal_ntile(scored):
    layout = lay_out(scored, "uplift", "id", ["arm"], rows_per_bucket=50)
    got = equal_bins(layout, 7)
    want = ranks(scored).withColumn(
        "tile", F.ntile(7).over(Window.partitionBy("arm").orderBy("want"))
    )
    assert got.count() == 4000
    assert got.join(want, "id").filter("bin <> tile").count() == 0


def test_more_bins_than_rows(spark):
    rows = spark.range(3).select("id", F.col("id").cast("double").alias("s"))
    got = equal_bins(lay_out(rows, "s", "id"), 5)
    assert sorted(r["bin"] for r in got.collect()) == [1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 333, 5000])
def test_first_rows(scored, n):
    layout = lay_out(scored, "uplift", "id", ["arm"], rows_per_bucket=50)
    got = {r["id"] for r in first_rows(layout, n).select("id").collect()}
    want = {r["id"] for r in ranks(scored).filter(F.col("want") <= n).collect()}
    assert got == want


def test_hashed_layout(scored):
    layout = lay_out_hashed(scored, "id", 3, ["arm"], rows_per_bucket=100)
    got = {r["id"] for r in first_rows(layout, 100).select("id").collect()}
    order = Window.partitionBy("arm").orderBy(hash_int("id", 3), "id")
    want = scored.withColumn("p", F.row_number().over(order)).filter("p <= 100")
    assert got == {r["id"] for r in want.collect()}


def test_quantiles_equal_percentile(scored):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(scored, "uplift", "id", probabilities, ["arm"], rows_per_bucket=50)
    want = scored.groupBy("arm").agg(F.percentile("uplift", probabilities).alias("q"))
    expected = {
        (r["arm"], p): q for r in want.collect() for p, q in zip(probabilities, r["q"])
    }
    actual = {(r["arm"], r["p"]): r["cut"] for r in got.collect()}
    assert actual.keys() == expected.keys()
    assert all(abs(actual[k] - expected[k]) < 1e-12 for k in expected)


@pytest.mark.parametrize("kind", ["lift", "gain", "qini"])
def test_curves_do_not_depend_on_buckets(scored, kind):
    def rows(size):
        curve = curves.uplift_curve(scored, kind, keep_random=True, rows_per_bucket=size)
        return sorted((r["arm"], r["k"], round(r["value"], 10), round(r["random"], 10))
                      for r in curve.collect())

    assert rows(40) == rows(10**6)


def test_areas_do_not_depend_on_buckets(scored):
    for fn in (curves.auuc, curves.qini_score, curves.calibration):
        got = [sorted(map(repr, fn(scored, rows_per_bucket=s)
                          .select(*[c if t == "string" or c in ("arm", "bin", "n") else F.round(c, 9)
                                    for c, t in fn(scored).dtypes]).collect()))
               for s in (40, 10**6)]
        assert got[0] == got[1]
    top = [sorted(map(repr, curves.top_n_lift(scored, 700, rows_per_bucket=s).collect()))
           for s in (40, 10**6)]
    assert top[0] == top[1]


def test_leading_gap_over_several_buckets(spark):
    """The first 60 ranks are all treated, so the lift is a straight line up to rank 61."""
    rows = spark.range(100).select(
        "id", F.lit("a").alias("arm"), (-F.col("id")).cast("double").alias("uplift"),
        (F.col("id") < 60).cast("int").alias("treatment"), (F.col("id") % 2).cast("int").alias("label"),
    )
    got = {r["k"]: r["value"] for r in curves.uplift_curve(rows, rows_per_bucket=10).collect()}
    at_61 = 30 / 60 - 0.0
    assert got[0] == 0.0 and got[61] == pytest.approx(at_61)
    assert all(got[k] == pytest.approx(at_61 * k / 61) for k in range(1, 61))


def test_arm_without_treated_rows(spark):
    rows = spark.range(5).select(
        "id", F.lit("a").alias("arm"), F.col("id").cast("double").alias("uplift"),
        F.lit(0).alias("treatment"), F.lit(1).alias("label"),
    )
    assert {r["value"] for r in curves.uplift_curve(rows).collect()} == {0.0}
    assert curves.auuc(rows).first()["auuc"] is None


def test_balance_with_one_side_missing(spark):
    rows = spark.range(5).select("id", F.lit(1).alias("side"))
    assert balance(rows, "side", "id").count() == 0


def test_null_group_is_a_group_at_any_number_of_buckets(scored):
    rows = scored.withColumn("arm", F.when(F.col("arm") == "big", F.col("arm")))
    for few, many in (
        (curves.auuc(rows), curves.auuc(rows, rows_per_bucket=50)),
        (curves.top_n_lift(rows, 700), curves.top_n_lift(rows, 700, rows_per_bucket=50)),
        (curves.calibration(rows), curves.calibration(rows, rows_per_bucket=50)),
        (curves.uplift_curve(rows, "qini"), curves.uplift_curve(rows, "qini", rows_per_bucket=50)),
    ):
        few, many = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr) for df in (few, many))
        assert few == many
        assert {r[0] for r in few} == {"big", None}
    taken = first_rows(lay_out(rows, "uplift", "id", ["arm"], rows_per_bucket=50), 30)
    assert {r.arm: r["count"] for r in taken.groupBy("arm").count().collect()} == {"big": 30, None: 30}
