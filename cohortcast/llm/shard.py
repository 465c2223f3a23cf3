"""Reproducible shuffle into shards: a keyed permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.llm.common import numbered

ROUND_KEYS = (7211, 40503, 65537, 99991)
SHARD_BYTES = 16


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def sides(total: int) -> tuple[int, int]:
    """Near-square grid of at least ``total`` cells; fewer than one of its rows are spare."""
    rows = math.isqrt(max(0, total - 1)) + 1
    return rows, max(1, -(-total // rows))


def feistel(number: Column, total: int, seed: int) -> Column:
    """One pass of a permutation of the grid's cells: each half moves by a hash of the other."""
    rows, columns = sides(total)

    def turn(half: Column, key: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(half, _long(seed), key), _long(size))

    def move(state: Column, key: Column) -> Column:
        a = F.pmod(state["a"] + turn(state["b"], key, rows), _long(rows))
        b = F.pmod(state["b"] + turn(a, -key, columns), _long(columns))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(
        F.pmod(number, _long(rows)).alias("a"),
        ((number - F.pmod(number, _long(rows))) / _long(rows)).cast("long").alias("b"),
    )
    keys = F.array(*[_long(key) for key in ROUND_KEYS])
    return F.aggregate(keys, start, move, lambda s: s["a"] + s["b"] * _long(rows))


def permuted(number: Column, total: int, seed: int, steps: int) -> Column:
    """The permutation of [0, total): a pass, and up to ``steps`` more from a spare cell."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)), number,
        lambda p, step: F.when((step == 0) | (p >= total), feistel(p, total, seed)).otherwise(p),
    )


def walk_steps(spark: SparkSession, total: int, seed: int) -> int:
    """Most passes that a walk from a number of [0, total) spends on spare cells, plus one.

    A walk that leaves the range goes on through spare cells only, and these are fewer than the
    root of ``total``: all are tried in a small job. A spare cell that comes back to itself first
    lies on a cycle of spare cells, which no walk from the range enters.
    """
    rows, columns = sides(total)
    start, steps = F.col("id"), 1

    def walked(count: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(count)), start,
            lambda p, step: F.when(
                (step == 1) | ((p >= total) & (p != start)), feistel(p, total, seed)
            ).otherwise(p),
        )

    spare = spark.range(total, rows * columns)
    while not spare.filter((walked(steps) >= total) & (walked(steps) != start)).isEmpty():
        steps += 1
    return steps + 1


def shard_rows(
    df: DataFrame, shards: int, seed: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every row under the law ``rows``: shard sizes differ by one at most.

    Rows are numbered in the order of (id, text checksum, size), the number is permuted, and the
    permuted number modulo the shards is the shard, its quotient the slot. Shard and slot can so
    be computed from the row number alone, and a reader finds any place without a lookup.

    Returns id, size (UTF-8 bytes and ``SHARD_BYTES``), text_crc32, law, shard, slot and
    grown_shard (NULL: this law moves rows when a shard is added). NULL texts count as empty with
    checksum 0, NULL ids come first. Rows equal in all three values are interchangeable: which
    copy gets which place is open, the set of results is not. An empty table gives an empty
    result; other columns are ignored. No group is kept together, so groups of copies of any size
    are dealt evenly.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(SHARD_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows, total = numbered(rows, ["_id", "text_crc32", "size"], "shard_rows")
    steps = walk_steps(df.sparkSession, total, seed) if total else 0
    placed = rows.withColumn("_place", permuted(F.col("row_no"), max(1, total), seed, steps))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_place", _long(shards)).cast("int").alias("shard"),
        ((F.col("_place") - F.pmod("_place", _long(shards))) / _long(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
