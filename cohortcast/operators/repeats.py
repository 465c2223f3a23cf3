"""Balanced samples drawn many times over, and their curves in one sorted pass.

A row carries one bit per repeat instead of being copied for each. Draw s keeps, of the larger side of
a group, the rows with the smallest hash of (id, s), as many as the smaller side has. Running sums
over the score order are vectors with one entry per repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.hashing import HASH_RANGE
from cohortcast.operators.ordering import GROUP, KEY, POS, SUB, TIE, broadcast_if_small, group_key, lay_out
from cohortcast.session import stage

WORD = 62
#: Half width, in standard deviations, of the stretch of hashes in which a draw's limit is looked for.
DEVIATIONS = 6.0
BLOCK = 4096


def _words(repeats: int) -> list[str]:
    return [f"_m{w}" for w in range(-(-repeats // WORD))]


def hashes(texts: list[str], repeats: int) -> np.ndarray:
    """``hash_int`` of every text and seed, as a matrix."""
    seeds = [f"|{s}".encode() for s in range(repeats)]
    data = b"".join(hashlib.md5(t + s).digest()[:8] for t in (x.encode() for x in texts) for s in seeds)
    return (np.frombuffer(data, dtype=">u8").astype(np.uint64) >> np.uint64(4)).astype(np.int64).reshape(len(texts), repeats)


def _pack(bits: np.ndarray) -> list[pa.Array]:
    out = []
    for start in range(0, bits.shape[1], WORD):
        part = bits[:, start : start + WORD].astype(np.int64)
        out.append(pa.array((part << np.arange(part.shape[1])).sum(axis=1)))
    return out


def _marked(rows: DataFrame, repeats: int, deviations: float) -> DataFrame:
    """Rows with the bits that are certain, and in ``_open`` the (seed, hash) that are near the limit."""
    share = F.col("_keep") / F.col("_n")
    width = deviations * F.sqrt(share * (1 - share) / F.col("_n")) + deviations / F.col("_n")
    cut = F.col("_keep") < F.col("_n")
    low = F.when(cut, F.floor(F.greatest(F.lit(0.0), share - width) * HASH_RANGE)).otherwise(F.lit(int(HASH_RANGE))).cast("long")
    high = F.when(cut, F.ceil(F.least(F.lit(1.0), share + width) * HASH_RANGE)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"_low": low, "_high": high, "_text": F.col("_id").cast("string")})
    words = _words(repeats)
    keep = [f.name for f in rows.schema if f.name not in ("_low", "_high", "_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            low, high = (batch.column(at[n]).to_numpy() for n in ("_low", "_high"))
            bits, near = np.ones((len(batch), repeats), dtype=bool), np.zeros((len(batch), repeats), dtype=bool)
            some = np.flatnonzero(high > 0)
            if len(some):  # a control stands in several groups: hash each id once
                texts = batch.column(at["_text"]).take(pa.array(some)).dictionary_encode()
                drawn = hashes([t or "" for t in texts.dictionary.to_pylist()], repeats)[texts.indices.to_numpy()]
                bits[some] = drawn < low[some, None]
                near[some] = ~bits[some] & (drawn <= high[some, None])
            rows_, seeds = np.nonzero(near)
            offsets = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)
            found = drawn[np.searchsorted(some, rows_), seeds] if len(some) else np.zeros(0, dtype=np.int64)
            items = pa.StructArray.from_arrays([pa.array(seeds.astype(np.int32)), pa.array(found)], names=["seed", "hash"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[n]) for n in keep), *_pack(bits), pa.ListArray.from_arrays(pa.array(offsets), items)],
                names=[*keep, *words, "_open"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return stage(rows.mapInArrow(run, f"{kept}, " + ", ".join(f"{w} long" for w in words) + ", _open array<struct<seed int, hash long>>"), "marked")


def _counts(stream: Iterator[pa.RecordBatch], repeats: int, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Per task and side of a group: in how many rows each draw's bit is set."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys, counts = list(zip(*held, strict=True)), [x.tolist() for x in held.values()]
        held.clear()
        columns = [pa.array(keys[0]), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int64()), pa.array(counts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[GROUP, "_side", "_keep", "counts"])

    for batch in stream:
        names = batch.column(0).dictionary_encode()
        sides, keep = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        which = 2 * names.indices.to_numpy().astype(np.int64) + sides
        words = [batch.column(3 + w).to_numpy(zero_copy_only=False) for w in range(len(_words(repeats)))]
        for value in np.unique(which).tolist():
            rows = np.flatnonzero(which == value)
            key = (names.dictionary[value // 2].as_py(), value % 2, int(keep[rows[0]]))
            total = held.setdefault(key, np.zeros(repeats, dtype=np.int64))
            for at in range(0, len(rows), BLOCK):
                total += _bits([w[rows[at : at + BLOCK]] for w in words], repeats).sum(axis=0).astype(np.int64)
        if len(held) >= most:
            yield flush()
    if held:
        yield flush()


def draw_balanced(df: DataFrame, repeats: int, groups: Sequence[str], treatment: str, id_col: str, deviations: float = DEVIATIONS) -> DataFrame:
    """Rows with their group key, ``_side`` (1 treated), ``_id`` and the bits ``_m0`` .. of the draws they are in.

    A draw's limit, the hash and id of its last row, is looked for in a narrow stretch around the
    share that is kept: rows below are counted, only those in the stretch, some root of a side's rows
    per draw, are ranked. Should a limit lie outside, the stretch is doubled. Groups with one side
    have no rows.
    """
    side = (F.col(treatment) > 0).cast("int")
    rows = df.withColumns({GROUP: group_key(groups), "_side": side, "_id": F.col(id_col)})
    keys = [GROUP, "_side"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pair = Window.partitionBy(GROUP)
    sizes = sizes.withColumns({"_keep": F.min("_n").over(pair), "_sides": F.count(F.lit(1)).over(pair)})
    sizes = stage(sizes.filter("_sides = 2").drop("_sides"), "sides")
    n_sides = sizes.count()
    rows = rows.join(broadcast_if_small(sizes, n_sides), keys)
    while True:
        marked = _marked(rows, repeats, deviations)
        kinds = f"{GROUP} string, _side int, _keep long, counts array<long>"
        certain = marked.filter("_keep < _n").select(*keys, "_keep", *_words(repeats))
        below = certain.mapInArrow(lambda batches: _counts(batches, repeats), kinds)
        below = below.select(*keys, "_keep", F.posexplode("counts").alias("seed", "n"))
        below = below.groupBy(*keys, "_keep", "seed").agg(F.sum("n").alias("below"))
        near = marked.select(*keys, "_id", F.inline("_open"))
        order = Window.partitionBy(*keys, "seed").orderBy("hash", "_id")
        limits = near.withColumn("place", F.row_number().over(order)).join(below, [*keys, "seed"])
        limits = limits.filter(F.col("place") == F.col("_keep") - F.col("below"))
        limits = limits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("seed", F.struct("hash", "_id")))).alias("_limits"))
        limits = stage(limits, "limits")
        if limits.filter(F.size("_limits") == repeats).count() == sizes.filter("_keep < _n").count():
            break
        deviations *= 2
    some = F.size("_open") > 0
    open_ = marked.filter(some).join(broadcast_if_small(limits, n_sides), keys)
    words = {}
    for w, name in enumerate(_words(repeats)):
        def decide(mask: Column, o: Column, w: int) -> Column:
            inside = F.struct(o["hash"], F.col("_id")) <= F.element_at("_limits", o["seed"])
            here = F.floor(o["seed"] / WORD) == w
            return F.when(inside & here, mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(o["seed"], F.lit(WORD)).cast("int")))).otherwise(mask)

        words[name] = F.aggregate("_open", F.col(name), (lambda w: lambda mask, o: decide(mask, o, w))(w))
    decided = open_.withColumns(words).select(marked.columns)
    out = marked.filter(~some).unionByName(decided).drop("_open", "_n", "_keep")
    return out.filter(" OR ".join(f"{w} <> 0" for w in _words(repeats)))


def _bits(words: list[np.ndarray], repeats: int) -> np.ndarray:
    """Rows by draws: 1 where the row is in the draw."""
    parts = [(word[:, None] >> np.arange(min(WORD, repeats - w * WORD))) & 1 for w, word in enumerate(words)]
    return np.concatenate(parts, axis=1).astype(np.float64)


def _blocks(batch: pa.RecordBatch, start: int, stop: int, first: int, repeats: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(t, y, bits) of the rows start..stop, a few thousand at a time; t, y and the words begin at column ``first``."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)]
    for at in range(start, stop, BLOCK):
        t, y, *words = (c[at : min(stop, at + BLOCK)] for c in columns)
        yield t[:, None], y[:, None], _bits(words, repeats)


def _bucket_sums(stream: Iterator[pa.RecordBatch], repeats: int) -> Iterator[pa.RecordBatch]:
    """Per bucket the four sums of every draw. A bucket's rows come one after the other."""
    key, sums = None, np.zeros((4, repeats))

    def close() -> pa.RecordBatch:
        columns = [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=[GROUP, POS, SUB, "own"])

    for batch in stream:
        names, pos, sub = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        ids = names.indices.to_numpy()
        new = (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1]) | (sub[1:] != sub[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            here = (names.dictionary[int(ids[start])].as_py(), int(pos[start]), int(sub[start]))
            if here != key:
                if key is not None:
                    yield close()
                key, sums = here, np.zeros((4, repeats))
            for t, y, bits in _blocks(batch, start, stop, 3, repeats):
                sums += [(bits * t).sum(axis=0), bits.sum(axis=0), (bits * t * y).sum(axis=0), (bits * y).sum(axis=0)]
    if key is not None:
        yield close()


def _gain_parts(stream: Iterator[pa.RecordBatch], repeats: int) -> Iterator[pa.RecordBatch]:
    """Per bucket and draw: sum of gain, first rank with a defined lift and its lift, last rank and gain.

    The stream holds, bucket by bucket, first a row with the sums of all earlier buckets and then the
    bucket's rows in order.
    """
    names = [GROUP, POS, SUB, "body", "m", "v_m", "k", "last"]
    key, state, column = None, None, np.arange(repeats)

    def close() -> pa.RecordBatch:
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (state["body"], state["m"], state["v_m"], state["sums"][1], state["last"])]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), *lists], names=names)

    def add(t: np.ndarray, y: np.ndarray, bits: np.ndarray) -> None:
        n_t, n, y_t, y_all = (np.cumsum(x, axis=0) + s for x, s in zip((bits * t, bits, bits * t * y, bits * y), state["sums"], strict=True))
        state["sums"] = [x[-1] for x in (n_t, n, y_t, y_all)]
        n_c = n - n_t
        known = (n_t > 0) & (n_c > 0) & (bits > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            lift = np.where(known, y_t / n_t - (y_all - y_t) / n_c, 0.0)
        gain = lift * n
        state["body"] += gain.sum(axis=0)
        some = known.any(axis=0)
        new = some & np.isnan(state["m"])
        first, end = known.argmax(axis=0), len(bits) - 1 - known[::-1].argmax(axis=0)
        state["m"] = np.where(new, n[first, column], state["m"])
        state["v_m"] = np.where(new, lift[first, column], state["v_m"])
        state["last"] = np.where(some, gain[end, column], state["last"])

    for batch in stream:
        heads = np.flatnonzero(batch.column(3).to_numpy() == 0)
        stops = [*heads.tolist(), len(batch)]
        for block in _blocks(batch, 0, stops[0], 5, repeats):  # the last batch's bucket goes on
            add(*block)
        for head, stop in zip(stops[:-1], stops[1:], strict=True):
            if key is not None:
                yield close()
            key = tuple(batch.column(i)[head].as_py() for i in range(3))
            before = np.array(batch.column(4)[head].as_py(), dtype=np.float64).reshape(4, repeats)
            state = {"sums": list(before), "body": np.zeros(repeats), "m": np.full(repeats, np.nan), "v_m": np.zeros(repeats), "last": np.full(repeats, np.nan)}
            for block in _blocks(batch, head + 1, stop, 5, repeats):
                add(*block)
    if key is not None:
        yield close()


def _before(sums: DataFrame) -> DataFrame:
    """Sums of all earlier buckets of the group: (bucket, sums), an array like ``own``."""
    keys = [GROUP, POS, SUB]
    each = sums.select(*keys, F.posexplode("own").alias("i", "v"))
    order = Window.partitionBy(GROUP, "i").orderBy(POS, SUB).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("v", F.coalesce(F.sum("v").over(order), F.lit(0.0)))
    listed = F.array_sort(F.collect_list(F.struct("i", "v")))
    return each.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias("sums"))


def repeated_areas(
    df: DataFrame, repeats: int, groups: Sequence[str], treatment: str, label: str, score: str, id_col: str
) -> DataFrame:
    """Per group and seed: rows ``n`` of the draw, the sum ``area`` of its gain curve and its ``last`` value.

    The curve is that of the draw alone: ranks and rates count the draw's rows only.
    """
    groups = list(groups)
    drawn = draw_balanced(df.select(*groups, id_col, treatment, label, score), repeats, groups, treatment, id_col)
    layout = lay_out(stage(drawn.drop(GROUP), "drawn"), score, id_col, groups)
    t, y = F.col("_side").cast("double").alias("t"), F.col(label).cast("double").alias("y")
    words = _words(repeats)
    laid = layout.rows.select(*layout.keys, t, y, *words, KEY, TIE, "_id")
    together = laid.repartition(*layout.keys).sortWithinPartitions(*layout.keys).select(*layout.keys, "t", "y", *words)
    sums = together.mapInArrow(lambda batches: _bucket_sums(batches, repeats), f"{GROUP} string, {POS} int, {SUB} int, own array<double>")
    heads = _before(stage(sums, "bucket_sums")).withColumns(
        {"kind": F.lit(0), "t": F.lit(0.0), "y": F.lit(0.0)} | {w: F.lit(0).cast("long") for w in words}
        | {KEY: F.lit(None).cast("double"), TIE: F.lit(None).cast("long"), "_id": F.lit(None).cast(df.schema[id_col].dataType)}
    )
    rows = laid.withColumns({"kind": F.lit(1), "sums": F.lit(None).cast("array<double>")})
    columns = [*layout.keys, "kind", "sums", "t", "y", *words]
    both = heads.unionByName(rows).repartition(*layout.keys).sortWithinPartitions(*layout.keys, "kind", F.desc(KEY), TIE, "_id").select(columns)
    schema = f"{GROUP} string, {POS} int, {SUB} int, body array<double>, m array<double>, v_m array<double>, k array<double>, last array<double>"
    found = both.mapInArrow(lambda batches: _gain_parts(batches, repeats), schema)
    each = F.arrays_zip("body", "m", "v_m", "k", "last")
    found = found.select(GROUP, F.posexplode(each).alias("seed", "x")).select(GROUP, "seed", "x.*")
    known = ~F.isnan("m")
    # ranks grow along the buckets, so the first bucket with a defined lift has the smallest m
    per_draw = found.groupBy(GROUP, "seed").agg(
        F.max("k").cast("long").alias("n"), F.sum("body").alias("body"), F.min(F.when(known, F.col("m"))).alias("m"),
        F.min_by("v_m", F.when(known, F.col("m"))).alias("v_m"), F.max_by("last", F.when(known, F.col("k"))).alias("last"),
    )
    lead = F.col("v_m") * (F.col("m") - 1) * (2 * F.col("m") - 1) / 6
    named = layout.rows.select(GROUP, *groups).distinct()
    per_draw = per_draw.withColumns({"area": F.coalesce(F.col("body") + lead, F.lit(0.0)), "last": F.coalesce("last", F.lit(0.0))})
    return per_draw.filter("n > 0").join(layout.small(named), GROUP).select(*groups, "seed", "n", "area", "last")
