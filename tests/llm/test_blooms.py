"""Rows without given keys, most of them left where they are."""

from __future__ import annotations

import tracemalloc

import corpus_pipeline
from cohortcast.llm import blooms
from cohortcast.llm.common import stage

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_without(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id % 2000 as string) AS k", "id AS v")
    gone = stage(rows.filter("v % 3 = 0").select("k").distinct(), "gone")
    names = {r.k for r in gone.collect()}
    want = sorted((r.k, r.v) for r in rows.collect() if r.k not in names)
    for packed in (None, 255):  # a filter as it is, and one that holds everything
        if packed:
            monkeypatch.setattr(blooms, "seen", lambda rows, hashes_of, bits: blooms.np.full(bits // 8, 255, dtype=blooms.np.uint8))
        left = blooms.without(rows, gone, "k")
        assert sorted((r.k, r.v) for r in left.collect()) == want
        assert "Exchange" not in plan_of(left)
    assert blooms.without(rows, gone.limit(0), "k").count() == 3000


def test_texts_stay_in_place(spark):
    """Texts without a passage don't move to meet those that have one."""
    passage = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [(1, passage, "en", "s", 0), (2, "a clean text", "en", "s", 0), (None, None, None, None, None)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    left = corpus_pipeline.benchmark(spark, docs, SF_DIR)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]
    assert "Exchange" not in plan_of(left)


def test_a_task_holds_packed_filters():
    """A pair of filters of the largest size takes its bits, not a byte for each."""
    hashes = blooms.np.arange(1, 20_001, dtype=blooms.np.uint64) * blooms.np.uint64(0x9E3779B97F4A7C15)
    tracemalloc.start()
    pair = blooms.Pair(blooms.MOST_BITS)
    pair.add(hashes)
    pair.add(hashes[:5000])
    parts = [(once, twice) for _, once, twice in pair.segments()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < blooms.MOST_BITS
    once, twice = (blooms.np.frombuffer(b"".join(x), dtype=blooms.np.uint8) for x in zip(*parts, strict=True))
    assert blooms.holds(once, hashes).all() and blooms.holds(twice, hashes[:5000]).all()
    assert blooms.holds(twice, hashes[5000:]).mean() < 0.01
