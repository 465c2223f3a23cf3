from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortcast.llm import jaccard
from cohortcast.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def plain_set(text, words=3):
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, percent=90):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[top(k)] = min(i, names.get(top(k), i))
    return sorted(((i, len(sets[k]), names.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    return [rng.choice(["new", "other", "more"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, many fragments
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 3)
        monkeypatch.setattr(jaccard, "FINE_BLOCK", 4)
        monkeypatch.setattr(jaccard, "SET_BLOCK", 200)
        monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(60)]
    rows = []
    for group in range(8):
        base = [rng.choice(pool) for _ in range(rng.choice([9, 12, 40, 120]))]
        for _ in range(14):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03])))))
    rows += [(500 + k, "A  b\tc " * 3) for k in range(5)] + [(600, None), (601, ""), (602, "one"), (603, "ONE"), (604, "one two"), (605, " \n")]
    rows += [(None, rows[0][1]), (None, "alone here now x"), (0, rows[20][1]), (700, "long " * 30_000), (701, "long " * 20_000), (702, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, component_id int").repartition(4)
    got = sorted(map(tuple, jaccard.near_texts(df).collect()), key=repr)
    assert got == brute(rows)


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(3, "the same few words")] * 40 + [(2, "the same few words")], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.near_texts(df).collect()} == {(3, 2, 2), (2, 2, 2)}
    assert jaccard.near_texts(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \té", max_size=30), min_size=1, max_size=6))
def test_sets_have_the_right_sizes(texts):
    sets = jaccard.shingle_sets([t.encode() for t in texts])
    for text, grams in zip(texts, sets, strict=True):
        assert len(grams) == len(plain_set(text))
    for a, x in zip(texts, sets, strict=True):
        for b, y in zip(texts, sets, strict=True):
            assert len(np.intersect1d(x, y)) == len(plain_set(a) & plain_set(b))
            assert (jaccard.node_of(x) == jaccard.node_of(y)) == (plain_set(a) == plain_set(b))


def test_stretches_of_long_texts(monkeypatch):
    text = (b"some words " * 100)
    whole = jaccard.shingle_sets([text])[0]
    monkeypatch.setattr(jaccard, "PART_BYTES", 7)
    assert (jaccard.shingle_sets([text])[0] == whole).all()


def test_query_equals_sql(spark):
    df = QUERIES["op5_ngram_jaccard"](spark, SF_DIR)
    assert differences(df, connect(SF_DIR), ORACLES["op5_ngram_jaccard"]) == []


def test_memory_of_a_batch():
    """Hashing a batch of texts takes few times its bytes, and keeps next to nothing."""
    texts = [b" ".join(b"w%d" % (k * i % 7919) for i in range(400)) for k in range(1, 600)]
    jaccard._powers.__defaults__[0].clear()
    tracemalloc.start()
    sets = jaccard.shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    del sets
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1_000_000
    assert peak < 32 << 20
    assert kept < 4 << 20
