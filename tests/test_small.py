"""Hand-computed cases of scalars, sampling, balance and errors."""

from __future__ import annotations

import datetime as dt
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast import session
from cohortcast.functions import dates, scalars
from cohortcast.operators import arms, balance, feature_rank, frames, metrics, sampling
from cohortcast.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    assert one(spark, scalars.growth_weight(F.lit(0.0))) == 1.0
    assert one(spark, scalars.growth_weight(F.lit(50.0))) == pytest.approx(6.0)
    assert one(spark, scalars.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, scalars.norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
    assert sum(one(spark, scalars.softmax(F.array(F.lit(900.0), F.lit(901.0))))) == pytest.approx(1)
    assert [one(spark, scalars.percentile_label(F.lit(b), 8)) for b in (1, 2, 8)] == [
        "0-12", "12-25", "88-100"]


def test_run_dates():
    assert dates.run_dates(dt.date(2024, 3, 1)) == ("2024-03-01", "2024-02-29")


def test_bad_text_is_no_day(spark):
    assert one(spark, dates.text_day(F.lit("2024-13-01"))) is None
    days = one(spark, dates.text_days(F.array(F.lit("2024-05-10"), F.lit("x"))))
    assert days == [dt.date(2024, 5, 10), None]


def test_folds_and_splits_cover_everything(spark):
    rows = spark.range(1000).withColumn("userid", F.col("id") % 90)
    for exact in (False, True):
        folds = sampling.user_folds(rows, "userid", 4, exact=exact)
        assert folds.count() == 1000
        assert folds.groupBy("userid").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.countDistinct("userid").alias("n")).collect()]
    assert sorted(sizes) == [22, 22, 23, 23]
    split = sampling.assign_split(rows, "id")
    shares = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(shares.values()) == 1000 and 580 < shares["train"] < 700


def test_balance_groups(spark):
    algo, base = spark.range(10), spark.range(100, 150)
    a, b = sampling.balance_groups(algo, base, "id", 1, concat=False)
    assert (a.count(), b.count()) == (10, 10)
    assert sampling.balance_groups(algo, base, "id", 1).count() == 20


def test_arm_scores_use_the_given_control(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.1), (3, 1, 0.2)], "treatment int, label int, u double")
    algo, base = arms.arm_scores(rows, "treatment", "label", 3, "u", control=1)
    assert (algo.count(), base.count()) == (1, 1)
    assert base.first()["label"] == 1


def test_transport_against_plain_loop():
    rng = np.random.default_rng(0)
    t, c = rng.random((6, 3)), rng.random((5, 3))
    cost = np.array([[((a - b) ** 2).sum() for b in c] for a in t])
    kernel = np.exp(-cost - (-cost).max(axis=1, keepdims=True))
    a, b = np.full((6, 1), 0.5 / 6), np.full((5, 1), 0.5 / 5)
    u = a
    for _ in range(10):
        u = 1.0 / ((kernel / a) @ (b / (kernel.T @ u)))
    v = b / (kernel.T @ u)
    assert balance.transport_distance(t, c) == pytest.approx(2 * (u * v.T * kernel * cost).sum())
    assert balance.transport_distance(t, c[:0]) == 0.0


def test_unknown_names_raise(spark):
    rows = spark.range(1)
    with pytest.raises(ValueError):
        balance.balanced_loss(rows, "a", "b", use_ipm=True, ipm="other")
    with pytest.raises(ValueError):
        feature_rank.divergence_rank(rows, ["a"], "XX")


def test_auc_with_ties(spark):
    rows = spark.createDataFrame(
        [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.4, 1)], "p double, y int"
    )
    assert metrics.roc_auc(rows).first()["auc"] == pytest.approx(5 / 6)
    assert metrics.roc_auc(rows, rows_per_bucket=1).first()["auc"] == pytest.approx(5 / 6)
    assert metrics.roc_auc(rows.filter("y = 1")).first()["auc"] is None


def test_recency_weight(spark):
    rows = spark.createDataFrame([(3.0, 1.0, 10), (1.0, 2.0, 150), (5.0, 1.0, 151)],
                                 "label double, y_pred double, age int")
    weight = 10 / (1 + math.exp(-2 / 3)) - 4
    got = metrics.recency_weighted_loss(rows).first()
    assert got["weight"] == pytest.approx(weight)
    assert got["loss"] == pytest.approx((4 * weight + 1 * weight + 16) / 3)


def test_likelihood_ratio_finds_the_interaction(spark):
    h = lambda s: F.rand(s)
    rows = spark.range(4000).select(
        "id", (F.col("id") % 2).cast("int").alias("treatment"), h(1).alias("a"), h(2).alias("b"), h(3).alias("u")
    )
    rows = session.stage(rows, "lr")
    p = 0.3 + 0.4 * F.col("a") * F.col("treatment")
    rows = rows.withColumn("label", (F.col("u") < p).cast("int"))
    got = {r["feature"]: r for r in feature_rank.likelihood_ratio(rows, ["a", "b"]).collect()}
    assert got["a"]["score"] > 10 > got["b"]["score"] >= -1e-6
    assert got["a"]["p_value"] < 0.01


def test_fill_means_keeps_integers_without_nulls(spark):
    rows = spark.createDataFrame([(1, 2.0), (3, None)], "a int, b double")
    assert [tuple(r) for r in frames.fill_means(rows).collect()] == [(1, 2.0), (3, 2.0)]


def test_staging_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.staging_root(Session())


def test_day_overwrite_keeps_other_days_and_the_setting(spark):
    name = "days_of_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.create_day_table(spark, name, {"v": "bigint"}, location=session.staging_path(spark, "t"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v long, dt string")
    tables.overwrite_days(rows, name)
    tables.overwrite_days(spark.createDataFrame([("b", 9)], "dt string, v long"), name)
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (9, "b")]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    plan = tables.read_day(spark, name, "a", ["v"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_staged_paths_are_removed(spark):
    from cohortcast import session

    before, session._STAGED[:] = list(session._STAGED), []
    path = session.staging_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert session.drop_staged(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    session._STAGED[:] = before


def test_replaced_table_may_read_itself(spark, tmp_path):
    from cohortcast.sources import tables

    name = f"again_{tmp_path.name.replace('-', '_')}"
    tables.replace_table(spark.range(3), name, f"{tmp_path}/one", "parquet")
    tables.replace_table(spark.table(name).selectExpr("id + 1 AS id"), name, f"{tmp_path}/two", "parquet")
    assert sorted(r.id for r in spark.table(name).collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        tables.replace_table(spark.range(1).selectExpr("raise_error('no') AS id"), name, f"{tmp_path}/three", "parquet")
    assert spark.table(name).count() == 3
    spark.sql(f"DROP TABLE {name}")


def test_missing_scores_neither_ask_nor_match(spark):
    from cohortcast.operators import matching

    treated = spark.createDataFrame([(1, 3, 0.5), (2, 3, None), (3, 3, float("nan"))], "id long, arm int, a double")
    controls = spark.createDataFrame([(10, 0.51), (11, None), (12, float("nan")), (13, 0.9)], "id long, a double")
    got = matching.match_controls(treated, controls, ["a"], k=1).collect()
    assert [(r.arm, r.id) for r in got] == [(3, 10)]


def test_published_versions_are_always_there(spark, tmp_path, monkeypatch):
    name, seen, plain = f"shown_{uuid.uuid4().hex}", [], spark.sql
    tables.publish_version(spark.range(3), name, f"{tmp_path}/one", "parquet")

    def watched(text, *args, **more):
        out = plain(text, *args, **more)
        seen.append(sorted(r[0] for r in spark.table(name).collect()))  # a reader after every statement
        return out

    monkeypatch.setattr(spark, "sql", watched)
    tables.publish_version(spark.table(name).selectExpr("id + 1 AS id", "'x' AS more"), name, f"{tmp_path}/two", "parquet")
    monkeypatch.undo()
    assert seen and all(rows in ([0, 1, 2], [1, 2, 3]) for rows in seen) and seen[-1] == [1, 2, 3]
    assert spark.table(name).columns == ["id", "more"]
    with pytest.raises(Exception, match="no"):
        tables.publish_version(spark.range(1).selectExpr("raise_error('no') AS id"), name, f"{tmp_path}/three", "parquet")
    assert spark.table(name).count() == 3
    assert plain(f"SHOW TABLES LIKE '{name}__v*'").count() == 1
