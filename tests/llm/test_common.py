from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortcast.llm import common, groups


def test_running_sums(spark):
    rows = [([],), ([5],), ([1, 2, 3],), (list(range(500)),)]
    df = spark.createDataFrame(rows, "x array<bigint>")
    for r in df.select("x", common.mod_sums(F.col("x")).alias("s")).collect():
        assert r.s == list(itertools.accumulate(r.x, initial=0))[:-1]


def test_numbers_are_places_in_order(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(100)] + [(None, -1)] * 3, "a long, b long").repartition(5)
    out, total = common.numbered(df, ["a", "b"], "numbers")
    rows = sorted(out.collect(), key=lambda r: r.row_no)
    assert total == 103 and [r.row_no for r in rows] == list(range(103))
    assert [(r.a, r.b) for r in rows] == sorted([(None, -1)] * 3 + [(k % 7, k) for k in range(100)], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_groups_stay_whole():
    keys = np.repeat(np.arange(40), np.arange(40) % 9 + 1)
    batches = [pa.RecordBatch.from_arrays([pa.array(part)], names=["k"]) for part in np.array_split(keys, 13)]
    seen = [set(t.column("k").to_pylist()) for t in groups.whole_groups(iter(batches), "k", rows=10)]
    assert sum(map(len, seen)) == 40 and set().union(*seen) == set(range(40))
    pairs = {(int(a), int(b)) for i, j in groups.pairs_inside(keys) for a, b in zip(i, j)}
    assert pairs == {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if keys[a] == keys[b]}


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a" * n for n in (5, 5, 50, 1, 0, 9)])], names=["t"])
    parts = [p.column(0).to_pylist() for p in common.batches_of(iter([batch]), "t", 10)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
