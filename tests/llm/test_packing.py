from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortcast.llm import packing
from cohortcast.llm.queries import QUERIES


def plain_best_fit(lengths, sizes, openable, price):
    """One text after the other; contents of bins."""
    rooms, used = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            i = min(fits)[1]
        else:
            size = min((s for s in openable if s >= n), key=lambda s: (price(s) / (s // n), s))
            rooms.append(size), used.append(0)
            i = len(rooms) - 1
        rooms[i] -= n
        used[i] += n
    sizes = sorted(sizes)
    return sum(price(sizes[bisect.bisect_left(sizes, u)]) for u in used), sorted(used)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=150))
def test_same_bins_as_one_by_one(lengths):
    counts = Counter(lengths)
    for openable in ([64], [128]):  # with one size to open, bins of equal room are alike
        plan = packing.best_fit(counts, [8, 16, 32, 64, 128], openable, packing.sequence_cost)
        cost, used = plain_best_fit(lengths, [8, 16, 32, 64, 128], openable, packing.sequence_cost)
        assert sorted(u for _, n, u in plan.bins for _ in range(n)) == used
        assert plan.cost(packing.sequence_cost) == pytest.approx(cost)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=150))
def test_joint_plan_is_whole_and_no_dearer(lengths):
    sizes, counts = [8, 16, 32, 64], Counter(lengths)
    plan = packing.best_plan(counts, sizes)
    assert sum(used * n for _, n, used in plan.bins) == sum(lengths)
    assert sum(r[2] for r in plan.runs) == len(lengths)
    for openable in ([64], sizes):
        assert plan.cost(packing.sequence_cost) <= packing.best_fit(counts, sizes, openable, packing.sequence_cost).cost(packing.sequence_cost)


def check(rows, docs, sizes):
    """Every token of every text has its own place, bins are as small as their contents allow."""
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append((r.offset, r.length, r.capacity))
    want = defaultdict(int)
    for i, t in docs:
        want[i] += len((t or "").encode()) + 1
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == dict(want)
    assert sorted(bins) == list(range(len(bins)))
    for content in bins.values():
        end = 0
        for offset, length, capacity in sorted(content):
            assert offset == end
            end += length
            assert capacity == content[0][2]
        assert min(s for s in sizes if s >= end) == content[0][2]


def test_frame(spark):
    docs = [(i, "x" * (i * 37 % 500)) for i in range(400)] + [(None, None), (5, "x" * 185), (900, "")] + [(1000 + i, "same length") for i in range(700)]
    docs.append((2000, "é" * 3000))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, capacity int, _length int")
    check(packing.pack(df, sizes=(64, 128, 512)).collect(), docs, (64, 128, 512))
    assert packing.pack(df.limit(0)).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op1_best_fit_packing"](spark, sf_dir).collect(), docs, packing.SIZES)
