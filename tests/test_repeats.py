"""Repeated balanced samples in one pass against drawing and sorting every sample by itself."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.functions.hashing import hash_int
from cohortcast.operators import curves, repeats


def plain_hash(i, seed):
    return int(hashlib.md5(f"{i}|{seed}".encode()).hexdigest()[:15], 16)


def plain_lift(rows, seed):
    """rows: (id, treatment, label, score) of one group."""
    sides = [[r for r in rows if r[1] == t] for t in (0, 1)]
    keep = min(map(len, sides))
    drawn = [r for side in sides for r in sorted(side, key=lambda r: (plain_hash(r[0], seed), r[0]))[:keep]]
    drawn.sort(key=lambda r: (-r[3], plain_hash(r[0], 0), r[0]))
    n, y = [0, 0], [0.0, 0.0]
    values = []
    for _, t, label, _ in drawn:
        n[t] += 1
        y[t] += label
        values.append(y[1] / n[1] - y[0] / n[0] if min(n) else None)
    if not drawn:
        return None
    first = next(k for k, v in enumerate(values) if v is not None)
    values = [v if v is not None else values[first] * (k + 1) / (first + 1) for k, v in enumerate(values)]
    gain = [v * (k + 1) for k, v in enumerate(values)]
    last = gain[-1]
    return (sum(gain) / (len(gain) + 1) - last / 2) / abs(last) if last else None


def table(spark, n=700):
    rng = np.random.default_rng(8)
    rows = [("a", i, int(rng.random() < 0.2), int(rng.random() < 0.4), float(rng.integers(0, 50))) for i in range(n)]
    rows += [("b", i, int(rng.random() < 0.7), int(rng.random() < 0.4), 0.5) for i in range(n // 2)]  # one score for all
    rows += [(None, i, i % 2, i % 3 % 2, float(-i)) for i in range(60)]  # sides of equal size, NULL group
    rows += [("one side", i, 1, 1, 1.0) for i in range(5)]
    return rows, spark.createDataFrame(rows, "arm string, id long, treatment int, label int, uplift double")


@pytest.mark.parametrize("times, batch", [(3, "10000"), (70, "13")])
def test_equals_single_draws(spark, times, batch):
    rows, df = table(spark)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.arm, r.seed): r.lift for r in curves.auuc_repeated(df, times).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for arm in ("a", "b", None):
        part = [r[1:] for r in rows if r[0] == arm]
        for seed in range(times):
            want = plain_lift(part, seed)
            assert got.pop((arm, seed)) == (pytest.approx(want, abs=1e-12) if want is not None else None)
    assert not got  # a group with one side has no sample


def test_limit_outside_the_stretch(spark):
    rows, df = table(spark)
    narrow = repeats.draw_balanced(df, 9, ["arm"], "treatment", "id", deviations=0.01)
    wide = repeats.draw_balanced(df, 9, ["arm"], "treatment", "id", deviations=50.0)
    columns = ["arm", "id", "_m0"]
    assert sorted(narrow.select(columns).collect(), key=str) == sorted(wide.select(columns).collect(), key=str)


def test_hashes_are_those_of_the_columns(spark):
    df = spark.range(5).select(F.concat(F.lit("é"), "id").alias("id"))
    want = df.select("id", *[hash_int("id", s) for s in range(3)]).collect()
    assert repeats.hashes([r.id for r in want], 3).tolist() == [list(r)[1:] for r in want]
