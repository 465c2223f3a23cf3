"""Mixing sources to target weights: random order inside each source, prefix sums, cuts at exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import numbered, stage
from cohortcast.llm.ranges import running

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; words become one letter each, white space goes."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.octet_length(F.regexp_replace(letters, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Rows (_source, size) with ``target``: the words that each source gives.

    Weights go round in the order of names by code point, NULL last. All targets together are
    ``share`` of all words; none is above ``most`` times its source's size. The excess of those that
    would be is dealt to the others by weight again, until none is above: every target is then
    least(its bound, its weight times one common level). For any set of bounded sources the level
    is at least what the rest must share by weight, and for the right set, a prefix of the order of
    bound / weight, it is that: so it is the largest such quotient, one aggregate over prefix sums.
    """
    named, _ = numbered(sources.withColumn("_none", F.col("_source").isNull()), ["_none", "_source"], "mix_sources")
    weight = F.array(*[F.lit(w).cast("long") for w in weights])
    named = named.select(
        "_source", "size", F.element_at(weight, (F.pmod("row_no", F.lit(len(weights))) + 1).cast("int")).alias("weight")
    ).withColumn("bound", F.col("size") * F.lit(float(most)))
    order = [(F.col("bound") / F.col("weight")), F.col("_source").isNull(), "_source"]
    parts = running(named, [], order, {"size": "sum", "weight": "sum"}, "mix_ratios")
    total = parts.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(float(share) * (total["size"] or 0)) - F.col("before_size") * F.lit(float(most))
    level = parts.agg(F.max(left / (F.lit(total["weight"] or 0) - F.col("before_weight")))).first()[0] or 0.0
    return named.select("_source", F.col("size").alias("source_size"), F.least("bound", F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(
    df: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 13,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """What a mix takes of every row: id, source, size, source_size, target, taken, epochs, cut.

    ``size`` counts the text's words (see ``word_count``; NULL: 0). ``target`` is the source's (see
    ``source_targets``). Each row has a random key, a hash of its id, its text and ``seed``. Rows are
    sorted by key inside their source, sizes are added up over the ranges of that order, and the
    source's budget, its target rounded to a whole word, is cut from it: whole epochs first
    (``epochs``), then rows from the start of the order until the budget is met exactly. The row that
    the budget ends in gives its first words only (``cut``). ``taken`` counts the words of all epochs.

    NULL is a source of its own. NULL ids and repeated rows pass; rows equal in id and text may swap
    their places, the set of results is the same in every run. Sources without words have target 0.
    Other columns are ignored, an empty table gives an empty result. A source of any size is spread
    over many ranges; its row of the small table is met by (range, source), never by source alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8")), F.lit(str(seed)))
    rows = df.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
        word_count(text).alias("size"), F.unhex(F.md5(F.encode(named, "UTF-8"))).alias("_key"),
    )
    rows = running(rows, ["_source"], ["_key", "_id", "size"], {"size": "sum"}, "mix_rows")
    pieces = stage(rows.groupBy("_range", "_source").agg(F.sum("size").alias("size")), "mix_pieces")
    targets = stage(source_targets(pieces.groupBy("_source").agg(F.sum("size").alias("size")), weights, share, most), "mix_targets")
    spans = pieces.select("_range", F.col("_source").alias("_name")).join(targets, F.col("_name").eqNullSafe(F.col("_source")))
    spans = spans.select(F.col("_range").alias("_part"), "_name", "source_size", "target")
    same = (F.col("_range") == F.col("_part")) & F.col("_source").eqNullSafe(F.col("_name"))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before_size")))
    return rows.join(spans, same).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target",
        (whole * F.col("size") + part).alias("taken"),
        (whole + (part > 0).cast("long")).alias("epochs"), ((part > 0) & (part < F.col("size"))).alias("cut"),
    )
