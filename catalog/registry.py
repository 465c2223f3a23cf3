"""Registered queries: a Spark callable each and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(value: str | Column, digits: int, name: str | None = None) -> Column:
    """Rounded column; the name is kept for a plain column."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits).alias(name or value)


def day(name: str) -> Column:
    """A day column as text, so that both engines print it alike."""
    return F.col(name).cast("string").alias(name)
