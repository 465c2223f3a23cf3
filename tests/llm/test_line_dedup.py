from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cohortcast.llm import blooms, line_dedup
from cohortcast.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, min_docs, keep, min_words=0):
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for key in set(line_dedup.line_keys((t or "").encode())):
            if key and len(key.split()) >= min_words:
                holders[key].append(n)
    out = []
    first = {}
    for key, at in holders.items():
        if len({(rows[n][0], rows[n][1] if rows[n][0] is None else "") for n in at}) >= min_docs:
            first[key] = min((rows[n][0] is None, rows[n][0] or 0) for n in at)
    for i, t in rows:
        kept, used = [], set()
        lines = (t or "").split("\n")
        for line in lines:
            key = line_dedup.line_keys(line.encode())[0]
            if key in first:
                if keep == "first" and first[key] == (i is None, i or 0) and key not in used:
                    used.add(key)
                    kept.append(line)
            else:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


ROWS = [(i, f"Common\nline {i}\n COMMON \nÉté {i % 3}") for i in range(30)] + [
    (100, None), (101, ""), (102, "\n\n"), (103, "only\nonly\nonly"), (None, "common\nx"), (104, "a\n" * 20_000), (105, "b" * 300_000)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_equals_brute_force(spark, keep, min_docs):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, n_lines string, _extra int").repartition(5)
    got = line_dedup.dedup_lines(df, min_docs=min_docs, keep=keep)
    assert got.columns == ["doc_id", "text", "_extra", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == brute(ROWS, min_docs, keep)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same\nrest")] * 12, "doc_id long, text string")
    assert {(r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()} == {("same\nrest", 0)}  # one document
    twelve = df.withColumn("doc_id", line_dedup.F.monotonically_increasing_id())
    assert {(r.text, r.n_dropped) for r in line_dedup.dedup_lines(twelve).collect()} == {("", 2)}
    nameless = spark.createDataFrame([(None, f"same\n{i}") for i in range(12)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(nameless).collect()} == {1}
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_clashing_names(spark):
    names = ["_id", "_k1", "_k2", "_suspects", "_done", "_drop", "_key", "c0"]
    rows = [(i, "same\nown %d" % i, *range(len(names))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(i, f"own {i}", *range(len(names)), 2, 1) for i in range(12)]


def test_filters_miss_nothing():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    pair, other = blooms.Pair(1 << 20), blooms.Pair(1 << 20)
    pair.add(hashes[:3000]), other.add(hashes[2000:])
    parts = defaultdict(list)
    for segment, once, twice in [*pair.segments(), *other.segments()]:
        parts[segment].append((once, twice))
    packed = np.frombuffer(b"".join(blooms.merge(*zip(*parts[k]))[1] for k in sorted(parts)), dtype=np.uint8)
    assert blooms.holds(packed, hashes[2000:3000]).all()
    assert blooms.holds(packed, hashes[:2000]).mean() < 0.02


def test_query_equals_sql(spark):
    df = QUERIES["op8_line_dedup"](spark, SF_DIR)
    assert differences(df, connect(SF_DIR), ORACLES["op8_line_dedup"]) == []


def test_digest(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    from cohortcast.llm.queries import line_digest

    assert line_digest(line_dedup.dedup_lines(df)).collect()[0].kept_sha256 == hashlib.sha256(b"a\nb").hexdigest()
