from __future__ import annotations

import hashlib
import random
import re

import pytest

from cohortcast.llm import decontam
from cohortcast.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, tests, window):
    shapes = {}
    for item, text in tests:
        w = words(text)
        if w:
            for i in range(max(1, len(w) - window + 1)):
                shapes.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else None)
    sizes = {len(s) for s in shapes}
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for at in range(len(w)):
            for size in sizes:
                found = shapes.get(tuple(w[at : at + size]), ()) if at + size <= len(w) else ()
                if found:
                    hit.update(range(at, at + size))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names, key=lambda x: (x is None, x))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 24, 64])
def test_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontam, "CANDIDATES", 50)
    rng = random.Random(4)
    pool = ["a", "b", "c", "d", "é", "日", "x1"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(None, None), (100, ""), (101, "A b\tC!d é 日" * 30), (101, "A b\tC!d é 日" * 30), (102, "a " * 30_000)]
    tests = [(1, "a b c d é"), (2, "x1 x1"), (3, "D"), (4, None), (5, ""), (6, "!!"), (None, "c c"), (None, "x1 d c b"), (1, "b b b b b b"), (1, "a b c d é")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_words int, _hits string").repartition(4)
    found = decontam.find_passages(df, spark.createDataFrame(tests, "item_id long, text string"), window=4)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=repr)
    assert got == brute(docs, tests, 4)
    for r in found.collect():
        assert sum(b - a for a, b in zip(r.hits[::2], r.hits[1::2])) == r.n_hit
        assert set(r["items"]) - set(r.near_items) <= {"2", "3", None}  # windows of under three words are never near


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "zebra is a very quick animal that jumps over rivers"), (2, "zebra one two three four five six jumps")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, "zebra is a quick animal that jumps")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.near_items) for r in decontam.find_passages(docs, tests).collect()}
    assert got == {1: (0, ["9"]), 2: (0, [])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontam.digest(decontam.find_passages(docs.limit(0), tests)).collect() == []
    row = decontam.digest(decontam.find_passages(docs, tests.limit(0))).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated, row.items_sha256) == (2, 0, False, hashlib.sha256(b"").hexdigest())


def test_query_equals_sql(spark):
    df = QUERIES["op9_benchmark_passages"](spark, SF_DIR)
    assert differences(df, connect(SF_DIR), ORACLES["op9_benchmark_passages"]) == []
