"""CSV, ORC and parquet files as tables with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The tables a forecast reads and their columns.
BUNDLE = {
    "baseline": "dt string",
    "coupon_info": "dt string",
    "gmv_real_data": "ancestor_order_create_dt string, pay_gmv_d1 double",
    "price_level": "plan_date string, dim_prd_brand string, price_level string, pid bigint",
}


def read_csv_folder(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """All CSV files of a folder as one table."""
    return spark.read.schema(schema).option("header", True).csv(folder)


def read_bundle(
    spark: SparkSession, root: str, schemas: Mapping[str, str] = BUNDLE
) -> dict[str, DataFrame]:
    """One lazily read table per known sub-folder."""
    return {name: read_csv_folder(spark, f"{root}/{name}", s) for name, s in schemas.items()}


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_orc(df: DataFrame, path: str, rename: Mapping[str, str] | None = None) -> None:
    """Replace an ORC result, on request with renamed columns; a failed write publishes no rows."""
    df.withColumnsRenamed(dict(rename or {})).write.mode("overwrite").orc(path)


def read_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several intermediate parquet results as one table."""
    return spark.read.parquet(*paths)
