"""Run a registered query in Spark and its SQL in DuckDB and compare the values."""

from __future__ import annotations

import glob
import os

import duckdb

WHOLE = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "INTEGER": "int",
         "BIGINT": "int", "SMALLINT": "int", "TINYINT": "int"}
OTHER = {"boolean": "bool", "BOOLEAN": "bool", "double": "float", "DOUBLE": "float", "string": "text", "VARCHAR": "text"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(name: str) -> str:
    return WHOLE.get(name) or OTHER.get(name) or name


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark_df, con, sql: str, spark_rows=None) -> list[str]:
    """Empty when names, kinds of type and values agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _kind(str(d[1])) for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    spark_kinds = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema}
    if spark_kinds != kinds:
        return [f"schema: {sorted(spark_kinds.items())} against {sorted(kinds.items())}"]
    rows = spark_rows if spark_rows is not None else [tuple(x) for x in spark_df.collect()]
    actual = _rows(spark_df.columns, rows)
    if len(actual) != len(expected):
        return [f"rows: {len(actual)} against {len(expected)}"]
    return [f"{a} against {e}" for a, e in zip(actual, expected) if repr(a) != repr(e)][:5]
