from __future__ import annotations

import numpy as np
import pytest

from cohortcast.llm import ranges


@pytest.mark.parametrize("kind", ["sum", "xor"])
def test_running_equals_loop(spark, kind):
    rng = np.random.default_rng(3)
    keys = [None if k == 0 else f"k{k}" for k in np.minimum(rng.geometric(0.4, 4000), 9) - 1]
    rows = [(k, int(o), int(v), i) for i, (k, o, v) in enumerate(zip(keys, rng.integers(0, 500, 4000), rng.integers(0, 1 << 40, 4000), strict=True))]
    rows = list({(k, o): (k, o, v, i) for k, o, v, i in rows}.values())
    df = spark.createDataFrame(rows, "k string, o long, v long, _place long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "31")
    try:
        got = sorted((r.k or "", r.o, r.before_v) for r in ranges.running(df.drop("_place"), ["k"], ["o"], {"v": kind}, "t").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, held = [], {}
    for k, o, v, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.append((k or "", o, held.get(k, 0)))
        held[k] = held.get(k, 0) + v if kind == "sum" else held.get(k, 0) ^ v
    assert got == want


def test_running_without_key(spark):
    got = ranges.running(spark.range(1000).selectExpr("id", "1L AS one"), [], ["id"], {"one": "sum"}, "t")
    assert all(r.id == r.before_one for r in got.collect()) and got.count() == 1000
    assert ranges.running(spark.range(0).selectExpr("id", "1L AS one"), [], ["id"], {"one": "sum"}, "t").count() == 0


def test_carries():
    ends = [(("a",), ("a",), True, (3,)), (("a",), ("a",), True, (4,)), (("a",), ("b",), False, (5,)), (("c",), ("c",), True, (6,))]
    assert ranges.range_carries(ends, ["sum"]) == [(0,), (3,), (7,), (0,)]


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(ranges, "HOT_SHARE", 0.1)
    many = spark.range(1000).selectExpr("IF(id < 700, 0, id) AS k", "id AS v")
    one = many.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS w").filter("k <> 900")
    got = ranges.spread_join(many, one, ["k"], "n").collect()
    assert len(got) == 999 and all(r.w == 2 * r.k for r in got)
