"""Running values over sorted keys of any size, and joins that keep hot keys apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import stage, tidy

#: A key with more than this share of a side's rows is hot; there are at most 1 / share of them.
HOT_SHARE = 0.001
#: Each kind of running value: all of an array at once, and one value put before another.
KINDS: dict[str, tuple[np.ufunc, Callable[[int, int], int]]] = {
    "sum": (np.add, lambda a, b: a + b),
    "xor": (np.bitwise_xor, lambda a, b: a ^ b),
}


def key_starts(columns: Sequence[pa.Array], last: Sequence[pa.Scalar] | None) -> np.ndarray:
    """For each row whether its key differs from the row before; ``last`` is the key before the first."""
    count = len(columns[0]) if columns else 0
    new = np.zeros(count, dtype=bool)
    for i, column in enumerate(columns):
        a, b = column.slice(1), column.slice(0, count - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= unlike | (nulls[1:] != nulls[:-1])
        new[0] |= last is None or column[0].as_py() != last[i].as_py()
    return new


def run_values(values: np.ndarray, new: np.ndarray, carry: int, kind: str) -> np.ndarray:
    """Running values up to and with each row, from anew where ``new``; ``carry`` comes before the first row."""
    whole, put = KINDS[kind][0].accumulate(values), np.subtract if kind == "sum" else np.bitwise_xor
    starts = np.flatnonzero(new)
    base = np.where(starts > 0, whole[starts - 1], 0)
    which = np.cumsum(new)
    offsets = np.concatenate([np.array([-carry if kind == "sum" else carry], dtype=np.int64), base])
    return put(whole, offsets[which])


def range_carries(ends: list[tuple[tuple, tuple, bool, tuple]], kinds: Sequence[str]) -> list[tuple[int, ...]]:
    """What earlier ranges hold of each range's first key.

    ``ends`` has, in the order of ranges, the first key, the last key, whether they are one run, and
    the last key's values in the range.
    """
    carries, last, held = [], None, tuple(0 for _ in kinds)
    for first_key, last_key, single, values in ends:
        carry = held if last is not None and last == first_key else tuple(0 for _ in kinds)
        carries.append(carry)
        held = tuple(KINDS[k][1](c, v) for k, c, v in zip(kinds, carry, values, strict=True)) if single else values
        last = last_key
    return carries


def running(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column], values: dict[str, str], label: str
) -> DataFrame:
    """All columns, ``_range``, and ``before_<value>``: what earlier rows of the same key add up to.

    ``values`` names columns of longs without NULLs and how they add up (``sum`` or ``xor``). Rows
    are dealt to ranges of (key, order) and sorted there; a random last key cuts runs of equal
    rows, which are interchangeable. Each range is read once in order and written. Only a range's
    first key can go on from earlier ranges, so the driver sees one row per range and a key of any
    size is spread over many tasks. NULL is a key of its own; without keys all rows are one.
    """
    spark, key, names = df.sparkSession, list(key), list(values)
    kinds = [values[n] for n in names]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        df.withColumn("_tie", F.rand(23))
        .repartitionByRange(ranges, *key, *order, "_tie")
        .sortWithinPartitions(*key, *order, "_tie")
        .drop("_tie")
    )
    schema = dealt.schema.simpleString()[len("struct<"):-1]
    adds = ", ".join(f"before_{n} long" for n in names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, first = TaskContext.get().partitionId(), None, 0, True
        carry = [0] * len(names)
        for batch in batches:
            count = len(batch)
            if not count:
                continue
            at = [batch.schema.get_field_index(k) for k in key]
            columns = [batch.column(i) for i in at]
            new = key_starts(columns, last) if key else np.zeros(count, dtype=bool)
            if last is None and count:
                new[0] = False
            firsts = first & (np.cumsum(new) == 0)
            first = bool(firsts[-1])
            out = []
            for i, name in enumerate(names):
                own = batch.column(batch.schema.get_field_index(name)).to_numpy()
                through = run_values(own, new, carry[i], kinds[i])
                carry[i] = int(through[-1])
                out.append(through - own if kinds[i] == "sum" else through ^ own)
            last = [c[count - 1] for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(count, part)), pa.array(np.arange(place, place + count)), pa.array(firsts), *map(pa.array, out)],
                names=[*batch.schema.names, "_range", "_place", "_first", *(f"before_{n}" for n in names)],
            )
            place += count

    done = stage(dealt.mapInArrow(run, f"{schema}, _range long, _place long, _first boolean, {adds}"), label)
    through = [
        (F.col(f"before_{n}") + F.col(n) if kind == "sum" else F.col(f"before_{n}").bitwiseXOR(F.col(n))).alias(f"v{i}")
        for i, (n, kind) in enumerate(zip(names, kinds, strict=True))
    ]
    keys = F.struct(F.lit(0).alias("none"), *key)
    ends = done.groupBy("_range").agg(
        F.min_by(keys, "_place").alias("head"),
        F.max_by(F.struct(keys.alias("key"), F.col("_first").alias("single"), F.struct(*through).alias("sums")), "_place").alias("tail"),
    ).collect()
    ends.sort(key=lambda r: r["_range"])
    carries = range_carries([(tuple(r["head"]), tuple(r["tail"]["key"]), r["tail"]["single"], tuple(r["tail"]["sums"])) for r in ends], kinds)
    rows = [(r["_range"], *c) for r, c in zip(ends, carries, strict=True)]
    table = spark.createDataFrame(rows, "_range long, " + ", ".join(f"_c{i} long" for i in range(len(names))))
    out = done.join(F.broadcast(table), "_range")
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        add = F.when(F.col("_first"), F.col(f"_c{i}")).otherwise(F.lit(0).cast("long"))
        before = F.col(f"before_{name}")
        out = out.withColumn(f"before_{name}", before + add if kind == "sum" else before.bitwiseXOR(add))
    return out.select(*df.columns, "_range", *(f"before_{n}" for n in names))


def spread_join(many: DataFrame, one: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row per key and in ``rows`` its rows in ``many``.

    Keys with more than ``HOT_SHARE`` of all rows are at most ``1 / HOT_SHARE``, whatever the size of
    the data: their rows of ``one`` are broadcast, and the hot rows stay where they are. The others
    meet by a shuffle. Both sides are read twice and should be written tables; keys are not NULL.
    """
    keys = list(keys)
    total = one.agg(F.sum(rows)).first()[0] or 0
    bar = F.lit(int(total * HOT_SHARE))
    hot = one.filter(F.col(rows) > bar)
    cold = one.filter(F.col(rows) <= bar)
    met = many.join(F.broadcast(hot), keys)
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return met.unionByName(rest)
