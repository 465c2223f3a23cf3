"""Rank, cut and sum rows in score order without pulling a group into one task.

A plain ``Window.partitionBy(arm).orderBy(score)`` sends a whole arm to one task. Here the score
axis is cut into buckets of similar size first. A row's bucket is a function of its own values, so
counts and sums per bucket come from one map-side combined aggregate, running offsets from a small
table, and only the order inside a bucket needs a sort. Operations that cut the order (bins, first
n rows, quantiles) sort nothing but the buckets a cut falls into.

Ties in the score are ordered by a hash of the id, then by the id. The hash is uniform, so a score
shared by very many rows can be split into several buckets too.

Groups meet by a key that is never NULL, so a NULL group is a group like any other. There is one
path for every size: small inputs have several buckets as well.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.hashing import HASH_RANGE, hash_int
from cohortcast.session import stage

GROUP, POS, SUB, KEY, TIE = "_group", "_pos", "_sub", "_key", "_tie"
ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 8
MIN_HASH_BUCKETS = 64
SAMPLES_PER_BUCKET = 100
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count is known and small; otherwise Spark picks the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def group_key(groups: Sequence[str]) -> Column:
    """Text that names a row's group, NULL values included."""
    if not groups:
        return F.lit("")
    return F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})


@dataclass(frozen=True)
class Layout:
    """Rows with their bucket: ``_pos`` counts buckets from the first, ``_sub`` splits a hot tie."""

    rows: DataFrame
    groups: tuple[str, ...]
    order: tuple[Column, ...]
    n_groups: int
    n_buckets: int

    @property
    def keys(self) -> list[str]:
        return [GROUP, POS, SUB]

    @property
    def bucket_rows(self) -> int:
        """Upper bound for the rows of :meth:`offsets`."""
        return self.n_groups * self.n_buckets

    def small(self, df: DataFrame) -> DataFrame:
        """Hint for a table with one row per group."""
        return broadcast_if_small(df, self.n_groups)

    def small_buckets(self, df: DataFrame) -> DataFrame:
        """Hint for a table with one row per bucket."""
        return broadcast_if_small(df, self.bucket_rows)

    def local(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def offsets(self, **sums: Column) -> DataFrame:
        """Per bucket: group columns, rows ``_n``, rows before ``_n0``, rows of the group ``_total``.

        Every named sum gives the bucket's own ``_s_name`` and ``_b_name``, the sum before it.
        """
        aggs = [F.count(F.lit(1)).alias("_n")]
        aggs += [F.sum(c).alias(f"_s_{name}") for name, c in sums.items()]
        per_bucket = self.rows.groupBy(*self.keys, *self.groups).agg(*aggs)
        # at most n_buckets rows per group from here on
        group = Window.partitionBy(GROUP)
        before = group.orderBy(POS, SUB).rowsBetween(Window.unboundedPreceding, -1)
        columns = {
            "_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_total": F.sum("_n").over(group),
        }
        for name in sums:
            columns[f"_b_{name}"] = F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0))
        return per_bucket.withColumns(columns)

    def running(
        self, rows: DataFrame | None = None, spans: DataFrame | None = None, **sums: Column
    ) -> DataFrame:
        """Rank ``k`` from 1 and running sums, for all rows or for whole buckets of them.

        ``spans`` may give :meth:`offsets` of the same sums where they are already computed.
        """
        rows = self.rows if rows is None else rows
        local = self.local()
        frame = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = rows.withColumns(
            {"k": F.row_number().over(local).cast("long")}
            | {name: F.sum(c).over(frame) for name, c in sums.items()}
        )
        # the window already clusters the rows by these keys, so only the small side moves
        spans = self.offsets(**sums) if spans is None else spans
        out = out.join(spans.drop(*self.groups), self.keys)
        return out.withColumns(
            {"k": F.col("k") + F.col("_n0")}
            | {name: F.col(name) + F.col(f"_b_{name}") for name in sums}
        ).drop("_n", "_n0", "_total", *[f"_{p}_{name}" for name in sums for p in "sb"])

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(GROUP, POS, SUB, KEY, TIE, "_n", "_n0", "_total")


def _sizes(
    df: DataFrame, groups: Sequence[str], per_group: DataFrame | None = None
) -> tuple[int, int]:
    if per_group is None:
        per_group = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    n_rows, n_groups = per_group.agg(F.sum("n"), F.count(F.lit(1))).first()
    return n_rows or 0, n_groups


def _bucket_count(n_rows: int, rows_per_bucket: int) -> int:
    return max(MIN_BUCKETS, math.ceil(n_rows / rows_per_bucket))


def lay_out(
    df: DataFrame,
    score: str,
    id_col: str,
    groups: Sequence[str] = (),
    descending: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> Layout:
    """Buckets along ``score``; missing scores come last.

    The id identifies a row within its group; NULL is a group of its own.

    The cuts come from a small sample. They set only the sizes of the buckets, never the result.
    """
    value = F.col(score).cast("double")
    missing = F.lit(float("-inf"))
    key = F.coalesce(F.nanvl(value if descending else -value, missing), missing)
    rows = df.withColumns({GROUP: group_key(groups), KEY: key, TIE: hash_int(id_col, 0)})
    order = (F.desc(KEY), F.asc(TIE), F.asc(id_col))
    n_rows, n_groups = _sizes(df, groups)
    wanted = _bucket_count(n_rows, rows_per_bucket)
    fraction = min(1.0, SAMPLES_PER_BUCKET * wanted / max(1, n_rows))
    probabilities = [i / wanted for i in range(1, wanted)]
    quantiles = F.percentile_approx(KEY, probabilities, 10 * wanted)
    cuts: list[float] = rows.select(KEY).sample(fraction, seed=1).agg(quantiles).first()[0] or []
    if not cuts:  # no row in the sample: one bucket, on the same path
        rows = rows.withColumns({POS: F.lit(0), SUB: F.lit(0)})
        return Layout(rows, tuple(groups), order, n_groups, 1)

    repeats = Counter(cuts)
    hot = {v: n + 1 for v, n in repeats.items() if n > 1}
    # a hot value gets a bucket to itself, so that the tie hash alone orders it
    edges = set(repeats) | {math.nextafter(v, math.inf) for v in hot}
    splits = [-math.inf, *sorted(e for e in edges if math.isfinite(e)), math.inf]
    ways = [hot.get(low, 1) for low in splits[:-1]]
    rows = Bucketizer(splits=splits, inputCol=KEY, outputCol=POS).transform(rows)
    position = F.col(POS).cast("int")
    share = F.col(TIE).cast("double") / F.lit(HASH_RANGE)
    sub = F.floor(share * F.element_at(F.lit(ways), position + 1)).cast("int")
    rows = rows.withColumn(SUB, sub if hot else F.lit(0))
    rows = rows.withColumn(POS, F.lit(len(ways) - 1) - position)
    return Layout(rows, tuple(groups), order, n_groups, sum(ways))


def lay_out_hashed(
    df: DataFrame,
    id_col: str,
    seed: int | Column = 0,
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    per_group: DataFrame | None = None,
) -> Layout:
    """Buckets along the hash of (id, seed): a repeatable shuffle of every group.

    The id identifies a row within its group, so that hashes spread evenly.
    ``per_group`` may give the rows ``n`` per group where they are already counted.
    """
    n_rows, n_groups = _sizes(df, groups, per_group)
    # buckets of a hash cost nothing to place, and more of them leave less to rank
    buckets = max(_bucket_count(n_rows, rows_per_bucket), MIN_HASH_BUCKETS)
    rows = df.withColumns({GROUP: group_key(groups), KEY: hash_int(id_col, seed)})
    share = F.col(KEY).cast("double") / F.lit(HASH_RANGE)
    rows = rows.withColumns({POS: F.floor(share * buckets).cast("int"), SUB: F.lit(0)})
    return Layout(rows, tuple(groups), (F.asc(KEY), F.asc(id_col)), n_groups, buckets)


def _bin_of(k: Column, total: Column, bins: int) -> Column:
    """Bin of rank k when ``total`` rows are cut into bins whose first ``total % bins`` are longer."""
    size = F.floor(total / F.lit(bins)).cast("long")
    longer = total % F.lit(bins)
    head = longer * (size + 1)
    in_head = F.ceil(k / (size + 1)).cast("long")
    in_tail = longer + F.ceil(F.try_divide(k - head, size)).cast("long")
    return F.when(k <= head, in_head).otherwise(in_tail).cast("int")


def equal_bins(layout: Layout, bins: int, name: str = "bin") -> DataFrame:
    """Number rows 1..bins in order, bins of equal count; sorts only buckets that span two bins."""
    n0, n, total = F.col("_n0"), F.col("_n"), F.col("_total")
    spans = layout.offsets().withColumns(
        {"_lo": _bin_of(n0 + 1, total, bins), "_hi": _bin_of(n0 + n, total, bins)}
    )
    placed = layout.rows.join(layout.small_buckets(spans.drop(*layout.groups)), layout.keys)
    whole = placed.filter("_lo = _hi").withColumn(name, F.col("_lo"))
    split = placed.filter("_lo <> _hi").withColumn(
        name, _bin_of(n0 + F.row_number().over(layout.local()), total, bins)
    )
    return layout.finish(whole.unionByName(split).drop("_lo", "_hi"))


def first_rows(
    layout: Layout, limit: int | DataFrame, spans: DataFrame | None = None
) -> DataFrame:
    """The first rows of every group: a number, or a table of groups with ``_keep``.

    One row per group says which bucket the limit falls into, so rows past it are dropped where
    they are read; only that bucket is ranked.
    """
    spans = layout.offsets() if spans is None else spans
    spans = spans.select(GROUP, POS, SUB, "_n0")
    if isinstance(limit, int):
        spans = spans.withColumn("_keep", F.lit(limit).cast("long"))
    else:
        limit = limit.select(group_key(layout.groups).alias(GROUP), "_keep")
        spans = spans.join(layout.small(limit), GROUP)
    edge = F.max(F.struct(POS, SUB, "_n0", "_keep")).alias("_edge")
    edges = spans.filter("_n0 < _keep").groupBy(GROUP).agg(edge)
    at, cut = F.struct(POS, SUB), F.struct(F.col(f"_edge.{POS}").alias(POS), F.col(f"_edge.{SUB}").alias(SUB))
    kept = layout.rows.join(layout.small(edges), GROUP)
    last = (
        kept.filter(at == cut)
        .withColumn("k_", F.row_number().over(layout.local()))
        .filter(F.col("k_") + F.col("_edge._n0") <= F.col("_edge._keep"))
        .drop("k_")
    )
    return layout.finish(kept.filter(at < cut).unionByName(last).drop("_edge"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    id_col: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Interpolated quantiles per group as (groups, p, cut); NULL values do not count."""
    present = df.filter(F.col(value).isNotNull())
    layout = lay_out(present, value, id_col, groups, False, rows_per_bucket)
    # one row per bucket, read several times below
    spans = stage(layout.offsets(), "spans")
    at = F.col("p") * (F.col("_size") - 1)
    low = F.floor(at).cast("long") + 1
    ends = F.array(
        F.struct(low.alias("k"), F.lit(1).alias("low"), F.lit(0).alias("high")),
        F.struct(F.least(low + 1, "_size").alias("k"), F.lit(0).alias("low"), F.lit(1).alias("high")),
    )
    asked = (
        spans.groupBy(GROUP)
        .agg(F.max("_total").alias("_size"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .select(GROUP, "p", (at - F.floor(at)).alias("part"), F.inline(ends))
    )
    touched = asked.select(GROUP, "k").join(spans.select(*layout.keys, "_n0", "_n"), GROUP)
    wanted = touched.filter("k > _n0 and k <= _n0 + _n").select(*layout.keys).distinct()
    rows = layout.rows.join(layout.small_buckets(wanted), layout.keys, "left_semi")
    ranked = layout.running(rows, spans).select(GROUP, *groups, "k", F.col(value).cast("double").alias("v"))
    asked = broadcast_if_small(asked, layout.n_groups * 2 * len(probabilities))
    found = ranked.join(asked, [GROUP, "k"])
    low_v, high_v = (F.max(F.when(F.col(c) == 1, F.col("v"))) for c in ("low", "high"))
    cut = low_v + (high_v - low_v) * F.max("part")
    return found.groupBy(*groups, "p").agg(cut.alias("cut"))
