from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from cohortcast.llm import conversations, ranges
from cohortcast.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, group=5, heads=9):
    """Everything by tuples of turns; no two rows of a conversation may differ and share a turn number."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        turns = own.get(c - c % group, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def trie(df, **options):
    out = conversations.prefix_trie(df, **options)
    assert out.columns == COLUMNS
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def odd_rows():
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 1, "user", "é"), (7, 0, "", "")]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(12)]  # copies
    rows += [(c, t, "user", f"same {t}" if t < 2 else f"own {c % 7} {t}") for c in range(200, 300) for t in range(c % 11)]
    rows += [(1000, t, "bot", "x" * (t % 5)) for t in range(700)]  # one long conversation, and its twin
    rows += [(1005, t, "bot", "x" * (t % 5)) for t in range(650)]
    rows += [(2003, 0, "user", "base is absent"), (2007, 5, "user", "a"), (2007, 6, "user", "b" * 50_000)]
    return rows


@pytest.mark.parametrize("block, share", [(4, 0.02), (1, 0.001), (3, 0.3)])
def test_equals_brute_force(spark, monkeypatch, block, share):
    monkeypatch.setattr(ranges, "HOT_SHARE", share)
    rows = odd_rows()
    names = ["conv", "pos", "depth", "_range", "block"]  # clash with the columns inside
    df = spark.createDataFrame([(*r, *range(5)) for r in rows], SCHEMA + "".join(f", {n} int" for n in names)).repartition(6)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert trie(df, block=block) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_repeated_rows_are_turns(spark):
    rows = [(0, 1, "a", "x")] * 40 + [(1, 1, "a", "x")] * 40
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_same_turn_numbers_have_one_order(spark):
    rows = [(0, 1, "a", str(k)) for k in range(10)]
    one = trie(spark.createDataFrame(rows, SCHEMA))
    assert one == trie(spark.createDataFrame(rows[::-1], SCHEMA)) and len(one) == 11


def test_without_turns(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    absent = next(c for c in range(10_001, 10_100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(absent, 0, "user", "only turn")]  # its base is absent and its own turn goes
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [
        (absent, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())]


def test_ids_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_IDS", 10)
    ends = spark.range(5000).selectExpr("1L AS depth", "id % 2 AS d1", "0L AS d2", "id AS conv")
    got = {r.d1: r.ends_sha256 for r in conversations.id_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest() for k in (0, 1)}


def test_deep_hanging_paths(spark):
    paths = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(40)] + [(100 + i, 3, 1) for i in range(50)], "path long, up long, n long")
    got = {r.path: r.n for r in conversations.path_totals(paths, ["n"]).collect()}
    assert got == {i: 40 - i + (50 if i <= 3 else 0) for i in range(40)} | {100 + i: 1 for i in range(50)}


def test_query_equals_sql(spark):
    assert differences(QUERIES["op12_conversation_trie"](spark, SF_DIR), connect(SF_DIR), ORACLES["op12_conversation_trie"]) == []
