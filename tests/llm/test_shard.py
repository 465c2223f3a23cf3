from __future__ import annotations

import zlib
from collections import Counter

import pytest

from cohortcast.llm import shard


def check(rows, shards, total):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == total
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("total", [0, 1, 2, 3, 39, 41, 1000, 4097])
def test_law_and_permutation(spark, total):
    df = spark.range(total).selectExpr("id AS doc_id", "repeat('ab', cast(id % 7 as int)) AS text", "1 AS shard", "'x' AS _id")
    rows = shard.shard_rows(df, 40).collect()
    check(rows, 40, total)
    again = shard.shard_rows(df.repartition(3), 40).collect()
    assert sorted(rows) == sorted(again)
    if total > 1000:
        ordered = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
        assert ordered != sorted(ordered)
        assert shard.shard_rows(df, 40, seed=21).collect() != rows


def test_nulls_and_repeats(spark):
    rows = [(None, None, 1), (None, "", 2), (5, "é", 3), (5, "é", 3), (5, "z", 3)] + [(7, "same", 0)] * 500
    out = shard.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, size int"), 4).collect()
    check(out, 4, len(rows))
    want = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_every_number_has_one_place(spark):
    for total in (1, 2, 5, 10, 97, 1024, 5000):
        steps = shard.walk_steps(spark, total, 3)
        places = spark.range(total).select(shard.permuted(shard.F.col("id"), total, 3, steps).alias("p")).collect()
        assert sorted(r.p for r in places) == list(range(total))
