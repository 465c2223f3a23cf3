"""Queries that write and read back tables and files below the staging folder."""

from __future__ import annotations

import datetime as dt
import uuid

import pandas as pd
from pyspark.sql import functions as F

from catalog.fixtures import DAILY_SQL, GMV_SQL, PRICE_SQL, gmv, price_level, r, table
from catalog.registry import day, query, rnd
from cohortcast.operators import frames, series
from cohortcast.plans.daily_job import run_day
from cohortcast.session import staging_path
from cohortcast.sources import files, tables

EVENT_COLUMNS = [
    ("event_id", "bigint", "id"), ("user_id", "bigint", "user"), ("value", "double", "amount"),
]


def event_table(spark, sf_dir) -> str:
    """A day-partitioned ORC table filled with all events."""
    name = f"events_{uuid.uuid4().hex}"
    tables.create_day_table(
        spark, name, EVENT_COLUMNS, comment="events by day", properties={"pformat": "dt:yyyy-mm-dd"},
        location=staging_path(spark, "events"),
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.col("ts").cast("date").cast("string").alias("dt")
    )
    tables.overwrite_days(rows, name)
    return name


EVENTS_SQL = "ev AS (SELECT event_id, user_id, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt FROM events)"


@query(
    "day_partition_read",
    f"WITH {EVENTS_SQL} SELECT event_id, {r('value', 4, 'value')} FROM ev WHERE dt = '2024-01-15'",
)
def day_partition_read(spark, sf_dir):
    rows = tables.read_day(spark, event_table(spark, sf_dir), "2024-01-15", ["event_id", "value"])
    return rows.select("event_id", rnd("value", 4))


@query(
    "day_partition_overwrite",
    f"""WITH {EVENTS_SQL}
SELECT dt, COUNT(*) AS n,
       {r("SUM(CASE WHEN dt = '2024-01-15' THEN value * 2 ELSE value END)", 4, 'value')}
FROM ev GROUP BY dt""",
)
def day_partition_overwrite(spark, sf_dir):
    """One day is replaced through a pandas step; the other days stay."""
    source, target = event_table(spark, sf_dir), event_table(spark, sf_dir)

    def double(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(value=batch["value"] * 2)

    run_day(
        spark, source, target, ["event_id", "user_id", "value", "dt"], double,
        "event_id long, user_id long, value double, dt string", dt.date(2024, 1, 16),
    )
    per_day = spark.table(target).groupBy("dt")
    return per_day.agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4, "value"))


@query(
    "add_columns",
    f"""WITH {EVENTS_SQL}
SELECT dt, COUNT(*) AS n, COUNT(*) FILTER (dt = '2024-01-15') AS tagged FROM ev GROUP BY dt""",
)
def add_columns(spark, sf_dir):
    """New columns, an array among them, are NULL in partitions written before."""
    name = event_table(spark, sf_dir)
    tables.add_columns(spark, name, {"col4": "string", "col5": "array<bigint>"})
    day_rows = tables.read_day(
        spark, name, "2024-01-15", ["event_id", "user_id", "value", "dt"]
    ).select("*", F.lit("new").alias("col4"), F.array("event_id", "user_id").alias("col5"))
    kept = f"copy_{uuid.uuid4().hex}"
    # a partition cannot be read while it is replaced
    tables.replace_table(day_rows, kept, staging_path(spark, "day"))
    tables.overwrite_days(spark.table(kept), name)
    return spark.table(name).groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.count("col5").alias("tagged")
    )


@query(
    "table_as_select",
    "SELECT o_orderpriority AS priority, COUNT(*) AS n FROM orders GROUP BY 1",
)
def table_as_select(spark, sf_dir):
    name = f"orders_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"))
    tables.replace_table(rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n")), name,
                         staging_path(spark, "ctas"))
    return spark.table(name)


@query(
    "table_versions",
    """SELECT o_orderpriority AS priority, COUNT(*) AS n, 2 AS version, 1 AS tables FROM orders GROUP BY 1""",
)
def table_versions(spark, sf_dir):
    """A view moved to its second version, which is made from the first; one version is left."""
    name = f"orders_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"))
    tables.publish_version(rows, name, staging_path(spark, "version"))
    counted = spark.table(name).groupBy("priority").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(2))
    tables.publish_version(counted, name, staging_path(spark, "version"))
    left = spark.sql(f"SHOW TABLES LIKE '{name}__v*'").count()
    return spark.table(name).withColumn("tables", F.lit(left))


@query(
    "temp_view",
    "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 1",
)
def temp_view(spark, sf_dir):
    tables.register_view(table(spark, sf_dir, "orders"), "result_orders")
    return spark.sql("SELECT o_orderstatus AS status, count(*) AS n FROM result_orders GROUP BY 1")


@query(
    "orc_roundtrip",
    f"WITH {DAILY_SQL} SELECT CAST(dt AS VARCHAR) AS effective_dt, {r('label', 2, 'gmv')} FROM daily",
)
def orc_roundtrip(spark, sf_dir):
    path = staging_path(spark, "orc")
    daily = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    files.save_orc(daily, path, {"dt": "effective_dt", "label": "gmv"})
    return spark.read.orc(path).select(day("effective_dt"), rnd("gmv", 2))


@query(
    "csv_folder",
    f"WITH {GMV_SQL} SELECT ancestor_order_create_dt, {r('pay_gmv_d1', 2, 'pay_gmv_d1')} FROM gmv",
)
def csv_folder(spark, sf_dir):
    path = staging_path(spark, "csv")
    files.save_csv(gmv(spark, sf_dir), path)
    rows = files.read_csv_folder(spark, path, files.BUNDLE["gmv_real_data"])
    return rows.select("ancestor_order_create_dt", rnd("pay_gmv_d1", 2))


@query(
    "csv_bundle",
    f"""WITH {GMV_SQL}, {PRICE_SQL},
baseline AS (SELECT DISTINCT ancestor_order_create_dt AS dt FROM gmv),
coupon AS (SELECT DISTINCT plan_date AS dt FROM price WHERE price_level = 'low')
SELECT 'gmv_real_data' AS name, COUNT(*) AS n, MAX(ancestor_order_create_dt) AS last FROM gmv
UNION ALL SELECT 'price_level', COUNT(*), MAX(plan_date) FROM price
UNION ALL SELECT 'baseline', COUNT(*), MAX(dt) FROM baseline
UNION ALL SELECT 'coupon_info', COUNT(*), MAX(dt) FROM coupon""",
)
def csv_bundle(spark, sf_dir):
    """All four tables of the bundle, written and read back."""
    root, sales, prices = staging_path(spark, "bundle"), gmv(spark, sf_dir), price_level(spark, sf_dir)
    written = {
        "gmv_real_data": sales,
        "price_level": prices,
        "baseline": sales.select(F.col("ancestor_order_create_dt").alias("dt")).distinct(),
        "coupon_info": prices.filter("price_level = 'low'").select(F.col("plan_date").alias("dt")).distinct(),
    }
    for name, rows in written.items():
        files.save_csv(rows, f"{root}/{name}")
    counts = [
        rows.agg(F.count(F.lit(1)).alias("n"), F.max(rows.columns[0]).alias("last")).select(F.lit(name).alias("name"), "n", "last")
        for name, rows in files.read_bundle(spark, root).items()
    ]
    return frames.unite(counts)


@query(
    "union_result_files",
    f"""WITH {DAILY_SQL}
SELECT CAST(year(dt) AS INT) AS year, COUNT(*) AS n FROM daily GROUP BY 1""",
)
def union_result_files(spark, sf_dir):
    """Results written separately, read as one table."""
    daily = series.daily_sum(gmv(spark, sf_dir), "ancestor_order_create_dt", "pay_gmv_d1")
    paths = [staging_path(spark, f"part{i}") for i in range(2)]
    daily.filter(F.year("dt") < 1998).write.parquet(paths[0])
    daily.filter(F.year("dt") >= 1998).write.parquet(paths[1])
    rows = files.read_parts(spark, paths)
    return rows.groupBy(F.year("dt").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pandas_batches",
    "SELECT event_id, upper(event_type) AS event_type FROM events",
)
def pandas_batches(spark, sf_dir):
    def upper(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(event_type=batch["event_type"].str.upper())

    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return tables.map_batches(rows, upper, "event_id long, event_type string", partitions=8)
