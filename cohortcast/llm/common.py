"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.session import stage

__all__ = ["covered", "let", "mod_sums", "numbered", "batches_of", "release_memory", "tidy", "stage"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def covered(df: DataFrame, *replaced: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns but ``replaced`` under numbered names, which no inner column has; and name by name the number."""
    df = df.drop(*replaced)
    numbers = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*numbers.values()), numbers


def mod_sums(sizes: Column) -> Column:
    """Exclusive running sums of an array of longs: what comes before each element.

    Sums run inside blocks of about the root of the length and then over the blocks, so that the
    work grows as the length to the power 1.5 and not with its square.
    """

    def inside(block: Column) -> Column:
        return F.aggregate(
            block, F.array(F.lit(0).cast("long")),
            lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)),
        )

    def build(values: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), width)
        blocks = F.transform(starts, lambda at: inside(F.slice(values, at, width)))

        def join(parts: Column) -> Column:
            before = inside(F.transform(parts, lambda sums: F.element_at(sums, -1)))
            return F.flatten(
                F.zip_with(
                    parts, F.slice(before, 1, F.size(parts)),
                    lambda sums, add: F.transform(
                        F.slice(sums, 1, F.size(sums) - 1), lambda x: x + add
                    ),
                )
            )

        return let(blocks, join)

    return let(sizes, build)


def numbered(df: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """Rows with ``row_no``, their place from 0 in the given order, and the number of rows.

    The rows are dealt to ranges of the order and sorted there; a random last key cuts runs of
    equal rows, which nobody can tell apart. The sorted table is written once, so that later
    passes see the same places. The number of a row is its place in its range plus the sizes of
    earlier ranges, a table of one row per range: no task sees all rows.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        df.withColumn("_tie", F.rand(17))
        .repartitionByRange(ranges, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    dealt = stage(
        dealt.select(
            "*", F.shiftright("_at", 33).alias("_range"),
            F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place"),
        ).drop("_at"),
        label,
    )
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect())
    before, total = [], 0
    for number, size in sizes:
        before.append((number, total))
        total += size
    offsets = spark.createDataFrame(before, "_range long, _before long")
    out = dealt.join(F.broadcast(offsets), "_range").withColumn(
        "row_no", F.col("_before") + F.col("_place")
    )
    return out.drop("_range", "_place", "_before"), total


def release_memory() -> None:
    """Give freed memory back: Python workers live on between tasks and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that releases its memory at the end of the task."""

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one column has about ``most`` bytes in each; a longer value stays whole."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        if not len(array):
            continue
        ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[
            array.offset : array.offset + len(array) + 1
        ].astype(np.int64)
        at = 0
        while at < len(array):
            stop = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            stop = min(max(stop, at + 1), len(array))
            yield batch.slice(at, stop - at)
            at = stop
