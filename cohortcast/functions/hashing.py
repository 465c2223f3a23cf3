"""Repeatable pseudo-random numbers from ids, the same in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 15
HASH_RANGE = float(16**HASH_DIGITS)


def as_column(value) -> Column:
    """Column names stay columns, anything else becomes a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def hash_int(id_col: str | Column, seed: int | Column = 0) -> Column:
    """Uniform integer in [0, 16^15): the first 15 hex digits of md5('id|seed')."""
    text = F.concat_ws("|", as_column(id_col).cast("string"), as_column(seed).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def hash01(id_col: str | Column, seed: int | Column = 0) -> Column:
    """Uniform double in [0, 1) from :func:`hash_int`."""
    return hash_int(id_col, seed).cast("double") / F.lit(HASH_RANGE)
