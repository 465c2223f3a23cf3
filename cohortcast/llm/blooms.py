"""A pair of Bloom filters built by all tasks: hashes seen at least once, and at least twice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import batches_of, stage, tidy

BATCH_BYTES = 1 << 21
PROBES = 4
SEGMENT_BITS = 1 << 19
MOST_BITS = 1 << 25
FAN_IN = 64


def filter_bits(items: int) -> int:
    """Power of two with some ten bits per expected item, from 2**20 to ``MOST_BITS``.

    Past the bound the filters fill up and let more unique lines pass to the exact count: that
    costs shuffle, never a wrong result.
    """
    return min(MOST_BITS, max(1 << 20, 1 << (10 * max(1, items)).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers (n, PROBES) of 64-bit hashes by double hashing."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return ((hashes[:, None] + probes * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class Pair:
    """Both filters as packed bits, so that a task holds no more of them than it hands on."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        unique, counts = np.unique(hashes, return_counts=True)
        at = places(unique, self.bits)
        again = (counts > 1) | holds(self.once, unique)
        byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
        np.bitwise_or.at(self.twice, byte[again], bit[again])
        np.bitwise_or.at(self.once, byte, bit)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Packed parts in which anything is set."""
        size = SEGMENT_BITS // 8
        for k in range(0, self.bits // 8, size):
            once = self.once[k : k + size]
            if once.any():
                yield k // size, once.tobytes(), self.twice[k : k + size].tobytes()


def merge(once: Iterable[bytes], twice: Iterable[bytes]) -> tuple[bytes, bytes]:
    """Seen twice: twice in one part, or once in two of them."""
    all_once = all_twice = np.uint8(0)
    for o, t in zip(once, twice, strict=True):
        more = np.frombuffer(o, dtype=np.uint8)
        all_twice = all_twice | np.frombuffer(t, dtype=np.uint8) | (all_once & more)
        all_once = all_once | more
    return all_once.tobytes(), all_twice.tobytes()


def seen_twice(df: DataFrame, hashes_of, column: Column, bits: int) -> bytes:
    """Packed filter of the hashes that more than one row may hold.

    ``hashes_of`` turns an Arrow array of the binary ``column`` into one numpy array of hashes, distinct
    within a row. Every task fills a pair of filters of fixed size; their parts are merged by
    segment, at most ``FAN_IN`` at a time. What reaches the driver is the filter, ``bits`` / 8
    bytes whatever the input.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bits)
        for batch in batches_of(batches, "value", BATCH_BYTES):
            pair.add(hashes_of(batch.column(0)))
        for segment, once, twice in pair.segments():
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([once]), pa.array([twice])], names=["segment", "once", "twice"])

    schema = "segment long, part long, once binary, twice binary"
    parts = df.select(column.alias("value")).mapInArrow(run, "segment long, once binary, twice binary")
    parts = parts.select("segment", F.spark_partition_id().cast("long").alias("part"), "once", "twice")
    left = max(1, df.rdd.getNumPartitions())
    while True:
        group = F.floor(F.col("part") / FAN_IN).cast("long")

        def combine(key: tuple, rows: pa.Table) -> pa.Table:
            once, twice = merge(*((x.as_py() for x in rows.column(c)) for c in ("once", "twice")))
            return pa.table({"segment": [key[0].as_py()], "part": [key[1].as_py()], "once": [once], "twice": [twice]})

        parts = parts.withColumn("part", group).groupBy("segment", "part").applyInArrow(combine, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    out = np.zeros(bits // 8, dtype=np.uint8)
    size = min(bits, SEGMENT_BITS) // 8
    for row in parts.select("segment", "twice").collect():
        out[row[0] * size : row[0] * size + size] = np.frombuffer(row[1], dtype=np.uint8)
    return out.tobytes()


def seen(rows: DataFrame, hashes_of, bits: int) -> np.ndarray:
    """Packed filter of the hashes that ``hashes_of`` makes of each Arrow batch of ``rows``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bits)
        for batch in batches:
            pair.add(hashes_of(batch))
        for segment, once, _ in pair.segments():
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([once])], names=["segment", "once"])

    packed = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows.mapInArrow(run, "segment long, once binary").toLocalIterator():
        part = np.frombuffer(r[1], dtype=np.uint8)
        packed[r[0] * len(part) : (r[0] + 1) * len(part)] |= part
    return packed


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is surely not in ``keys``, and the others, most of which have theirs there.

    ``keys`` should be a written table with a column ``key``. Rows are told by a Bloom filter of its keys
    where they are read, so that only the others need to move to meet it.
    """
    spark = rows.sparkSession
    packed = seen(keys.select(F.xxhash64(key)), lambda batch: _unsigned(batch.column(0)), filter_bits(keys.count()))
    known = spark.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        return pa.array(holds(known.value, _unsigned(hashes)))

    found = held(F.xxhash64(key))
    return rows.filter(~found), rows.filter(found)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in the written table ``gone``; few of them move.

    Rows that the filter of ``gone`` holds send their keys alone to meet the table. Only those that it
    holds wrongly, found by a filter of theirs, come back whole by a join. Keys are not NULL.
    """
    still, maybe = parted(rows, gone, key)
    wrongly = stage(maybe.select(key).distinct().join(gone, key, "left_anti"), "wrongly_held")
    few = parted(maybe, wrongly, key)[1].join(wrongly, key, "left_semi")
    return still.unionByName(stage(few.select(rows.columns), "kept_rows"))


def _unsigned(hashes: pa.Array) -> np.ndarray:
    return hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes, len(packed) * 8)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
