from __future__ import annotations

import numpy as np
import pytest

from cohortcast.llm import graph, vectors
from cohortcast.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v) / np.linalg.norm(np.array(v, dtype=float)))
    ids = sorted(good)
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
             if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold}
    return links


def expected(ids, links):
    degree, root = dict.fromkeys(ids, 0), {i: i for i in ids}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                moved = True
    return degree, root


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100 + k: 100 for k in range(80)}
    assert graph.forest(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_no_link_below_and_few_missed(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    many = [base[rng.integers(300)] + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.2]) for _ in range(900)]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate([*base, *many])]
    rows += [(5000 + i, base[0].tolist(), 1) for i in range(60)]  # one large bucket of copies
    rows += [(6001, None, 1), (6002, [0.0] * 32, 1), (6003, [None] * 32, 1), (6004, [float("nan")] * 32, 1), (6005, base[0].tolist(), None), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1), (6008, [], 1)]
    df = spark.createDataFrame([(i, v, k, 1, "x") for i, v, k in rows], "vec_id long, embedding array<double>, label int, n_links int, id string")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    links = brute(rows)
    degree, root = expected([r[0] for r in rows], links)
    assert all(got[i].n_links <= degree[i] for i in degree)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(degree.values())
    assert got[6006].n_links == 1 and got[6007].component_id == 6006
    for i in (6001, 6002, 6003, 6004, 6005, 6008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0], 1), (2, [1.0], 1), (2, [1.0], 1), (3, [2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=repr)
    assert got == [(2, 1, 2, True), (3, 1, 2, False), (None, 0, None, False)]
    assert vectors.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_query_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    degree, _ = expected([r[0] for r in rows], brute(rows))
    got = {r.vec_id: r.n_links for r in QUERIES["op2_vector_near_dedup"](spark, sf_dir).collect()}
    assert all(got[i] <= degree[i] for i in degree)
    assert sum(got.values()) >= 0.98 * sum(degree.values())


@pytest.mark.parametrize("lean", [0.0, 2.0, 3.0])
def test_tables_catch_links_of_vectors_that_share_a_direction(lean):
    """Mean cosines of 0, 0.8 and 0.9: rotations are added until the probes are caught."""
    rng = np.random.default_rng(8)
    size, shared = 64, np.ones(64) / 8
    raw = rng.standard_normal((6000, size)) / 8 + lean * shared
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    codes = vectors.Codes(unit, 0.98, 11)
    assert codes.recall >= vectors.RECALL
    other = raw + rng.standard_normal(raw.shape) / 8 * 0.16 * np.linalg.norm(raw, axis=1, keepdims=True)
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    link = np.einsum("ij,ij->i", unit, other) >= 0.98
    a, b = codes.words(unit[link]), codes.words(other[link])
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    found = (codes.keys(a) == codes.keys(b)).any(axis=1) & (apart <= codes.radius)
    assert link.sum() > 500 and found.mean() >= 0.98
    strangers = np.bitwise_count(codes.words(unit[:3000]) ^ codes.words(unit[3000:])).sum(axis=1)
    assert (strangers > codes.radius).mean() > 0.9


def test_shared_direction_in_the_operator(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 32)) / 32**0.5 + 3 / 32**0.5
    near = base[rng.integers(400, size=400)] + rng.standard_normal((400, 32)) * 0.08
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*base, *near, *base[:50], *base[:50]])]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    degree, _ = expected([r[0] for r in rows], brute(rows))
    assert all(got[i] <= degree[i] for i in degree)
    assert sum(got.values()) >= 0.98 * sum(degree.values()) > 1000


def test_codes_of_few_or_flat_vectors():
    for unit in (np.ones((1, 1)), np.ones((5, 1)), np.eye(3), np.ones((4, 8)) / 8**0.5):
        codes = vectors.Codes(unit, 0.98, 6)
        keys = codes.keys(codes.words(unit))
        assert keys.shape == (len(unit), codes.tables) and (keys[0] == keys[0]).all()


def test_dense_cluster_over_many_blocks(spark, monkeypatch):
    """Different vectors that all link fill buckets of many blocks; copies and signed zeros count as vectors."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(10)
    middle = rng.standard_normal(24)
    tight = [middle + rng.standard_normal(24) * 0.02 for _ in range(200)]
    plain, signed = [1.0, 0.0] + [0.0] * 22, [3.0, -0.0] + [0.0] * 22
    rows = [(i, list(map(float, v)), 1) for i, v in enumerate([*tight, *[tight[0]] * 100, *rng.standard_normal((50, 24))])]
    rows += [(900, plain, 1), (901, signed, 1), (902, plain, 2)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    degree, root = expected([r[0] for r in rows], brute(rows))
    assert degree[0] == 299 and all(got[i].n_links <= degree[i] for i in degree)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(degree.values())
    assert {i: r.component_id for i, r in got.items()} == root
    assert (got[900].n_links, got[901].component_id, got[902].n_links) == (1, 900, 0)
