"""Catalog tables partitioned by day: definition, reads, overwrites, pandas steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_day_table(
    spark: SparkSession,
    name: str,
    columns: Mapping[str, str] | Sequence[tuple[str, str, str]],
    partition: str = "dt",
    comment: str = "",
    properties: Mapping[str, str] | None = None,
    location: str | None = None,
) -> None:
    """ORC table partitioned by a text day; columns are name → type or (name, type, comment)."""
    triples = [(n, t, "") for n, t in columns.items()] if isinstance(columns, Mapping) else columns
    listed = ", ".join(f"`{n}` {t} COMMENT {_text(c)}" for n, t, c in triples)
    parts = [f"CREATE TABLE {name} ({listed}, `{partition}` STRING) USING orc"]
    parts.append(f"PARTITIONED BY (`{partition}`)")
    if location:
        parts.append(f"LOCATION {_text(location)}")
    if comment:
        parts.append(f"COMMENT {_text(comment)}")
    if properties:
        listed = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
        parts.append(f"TBLPROPERTIES ({listed})")
    spark.sql(" ".join(parts))


def add_columns(spark: SparkSession, name: str, columns: Mapping[str, str]) -> None:
    """New columns at the end, arrays included; older partitions read them as NULL."""
    listed = ", ".join(f"`{n}` {t}" for n, t in columns.items())
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({listed})")


def replace_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "orc") -> None:
    """Create a table from a query's rows, in place of one of that name.

    The rows are written under a name of their own first, so a failed write leaves the old table,
    and the query may read it. ``path`` is a place without data.
    """
    spark, fresh = df.sparkSession, f"{name}__{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.option("path", path) if path else writer).saveAsTable(fresh)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


def publish_version(df: DataFrame, name: str, path: str | None = None, fmt: str = "orc") -> str:
    """Make a query's rows the new content of the view ``name``; returns the name of the version.

    Every version is a table of its own. The view moves to it in one change of the catalog, so a
    reader at any moment sees the old rows or the new ones, also when columns change, and a failed
    write changes nothing. Older versions are dropped only after that. ``path`` is a place without
    data; files of versions with a path stay for readers that have begun. The name must not be a table's.
    """
    spark, fresh = df.sparkSession, f"{name}__v{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.option("path", path) if path else writer).saveAsTable(fresh)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fresh}")
    short = fresh.split(".")[-1]
    space = f" IN {name.rsplit('.', 1)[0]}" if "." in name else ""
    for row in spark.sql(f"SHOW TABLES{space} LIKE {_text(name.split('.')[-1] + '__v*')}").collect():
        if row["tableName"] != short:
            spark.sql(f"DROP TABLE IF EXISTS {name.rsplit('.', 1)[0] + '.' if space else ''}{row['tableName']}")
    return fresh


def read_day(
    spark: SparkSession, name: str, day: str, columns: Sequence[str], partition: str = "dt"
) -> DataFrame:
    """Columns of one day; only that partition is read."""
    return spark.table(name).where(F.col(partition) == day).select(*columns)


def overwrite_days(df: DataFrame, name: str) -> None:
    """Write rows, replacing exactly the day partitions they belong to. Columns match by name.

    ``insertInto`` takes the overwrite mode from the session only, so it is set for this write.
    """
    conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")
    try:
        df.select(*df.sparkSession.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        conf.set(key, before)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def map_batches(
    df: DataFrame,
    step: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Run a pandas step over Arrow batches, with a declared result schema.

    The step sees a batch at a time, so memory does not grow with a partition. ``partitions``
    spreads few large inputs over more tasks before a heavy step.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield step(batch)

    source = df.repartition(partitions) if partitions else df
    return source.mapInPandas(run, schema)
