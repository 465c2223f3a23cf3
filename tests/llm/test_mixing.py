from __future__ import annotations

import re
from collections import defaultdict

import pytest

from cohortcast.llm import mixing
from cohortcast.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, bound those above, share the excess among the others, and so on."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def check(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert words == sorted(r["size"] for r in got)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.cut or r.taken == r.epochs * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
        assert sum(r.cut for r in got if r.source == s) <= 1


def test_hot_null_and_tiny_sources(spark):
    rows = [(i, "w " * (i % 40), "hot") for i in range(3000)] + [(5000 + i, "a b c", None) for i in range(30)]
    rows += [(6000 + i, f"\tone\x0btwo two {i}\n", s) for i, s in enumerate(["é", "z", "Z", "\U0001F600", "￿", ""] * 5)]
    rows += [(None, None, "none"), (None, "", "none"), (7, " \r\n ", "blank"), (8, "x" * 200_000 + " y", "z"), (None, "n n", "z")] + [(9, "same row", "rep")] * 50
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", size int, _key int, _range int").repartition(5)
    got = mixing.mix_sources(df).collect()
    check(rows, got)
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_key_is_random(spark):
    rows = [(i, "w", "a") for i in range(1000)] + [(5000, "w " * 100_000, "b")]
    got = sorted(mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), share=1.005, weights=(1, 400)).collect())
    some = [r.doc_id for r in got if r.source == "a" and r.taken]
    assert 0 < len(some) < 1000 and some[-1] - some[0] > 700
    other = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), share=1.005, weights=(1, 400), seed=14).collect()
    assert {r.doc_id for r in other if r.taken} != {r.doc_id for r in got if r.taken}


def test_empty_and_wordless(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix_sources(spark.createDataFrame([(1, " ", "a"), (2, None, None)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken, r.epochs) for r in got] == [(0, 0.0, 0, 0)] * 2


def test_query_equals_sql(spark):
    assert differences(QUERIES["op13_mix_sources"](spark, SF_DIR), connect(SF_DIR), ORACLES["op13_mix_sources"]) == []
