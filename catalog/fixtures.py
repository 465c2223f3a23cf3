"""The engine's inputs, derived from the given tables.

Each input is built twice: as a DataFrame for the Spark query and as SQL text for the check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.functions.hashing import hash01
from cohortcast.operators.arms import ARMS

# Spring Festival dates over the span of the orders table.
CALENDAR = {
    1995: dt.date(1995, 1, 31),
    1996: dt.date(1996, 2, 19),
    1997: dt.date(1997, 2, 7),
    1998: dt.date(1998, 1, 28),
    1999: dt.date(1999, 2, 16),
    2000: dt.date(2000, 2, 5),
    2001: dt.date(2001, 1, 24),
}
FEATURES = [f"feature_{i}" for i in range(1, 6)]
LEVELS = ["low", "mid", "high"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uplift_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, userid, treatment, label, rct_mark) from the orders."""
    key = F.col("o_orderkey")
    arm = F.when(key % 9 == 0, F.lit(0)).otherwise(key % 9 + 2)
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        key.alias("id"),
        F.col("o_custkey").alias("userid"),
        arm.cast("int").alias("treatment"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"),
        (F.col("o_custkey") % 5 == 0).cast("int").alias("rct_mark"),
    )


def uplift_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base with five features; orders without lines have NULL in three of them."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.sum("l_quantity").alias("feature_3"),
            F.round(F.avg("l_discount"), 6).alias("feature_4"),
            F.count(F.lit(1)).cast("double").alias("feature_5"),
        )
    )
    prices = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("feature_1")
    )
    balances = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("userid"), F.col("c_acctbal").alias("feature_2")
    )
    return (
        uplift_base(spark, sf_dir)
        .join(prices, "id")
        .join(balances, "userid", "left")
        .join(lines, "id", "left")
        .select("id", "userid", "treatment", "label", "rct_mark", *FEATURES)
    )


def _cycle(step: int, period: int):
    return ((F.col("id") * step) % period).cast("double") / F.lit(float(period))


def uplift_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base with one score column per arm."""
    scores = {f"uplift_{a}": _cycle(31 + a, 997) - 0.5 for a in ARMS}
    return uplift_base(spark, sf_dir).withColumns(scores)


def psm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base with one propensity column per arm: independent scores, one in 97 of each missing."""
    scores = {f"ps_score_{a}": F.when(F.col("id") % 97 != a, hash01("id", 40 + a)) for a in ARMS}
    return uplift_base(spark, sf_dir).withColumns(scores)


def gmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ancestor_order_create_dt, pay_gmv_d1) with the day as text."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").cast("string").alias("ancestor_order_create_dt"),
        F.col("o_totalprice").alias("pay_gmv_d1"),
    )


def price_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_date, dim_prd_brand, price_level, pid)."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    level = F.when(unit < 1400, "low").when(unit < 3000, "mid").otherwise("high")
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dim_prd_brand")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(brands, "l_partkey")
        .select(
            F.col("l_shipdate").cast("date").cast("string").alias("plan_date"),
            "dim_prd_brand",
            level.alias("price_level"),
            F.col("l_partkey").alias("pid"),
        )
    )


def rep_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, t, y) from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("x"),
        (F.col("vec_id") % 2).cast("int").alias("t"),
        (F.col("label") > 1).cast("int").alias("y"),
    )


# ---- the same inputs as SQL --------------------------------------------------------------------

BASE_SQL = """
base AS (
  SELECT o_orderkey AS id, o_custkey AS userid,
         CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 9 + 2 END AS INT) AS treatment,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label,
         CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS rct_mark,
         o_totalprice
  FROM orders)"""

SAMPLE_SQL = (
    BASE_SQL
    + """,
sample AS (
  SELECT b.id, b.userid, b.treatment, b.label, b.rct_mark, b.o_totalprice AS feature_1,
         c.c_acctbal AS feature_2, l.feature_3, l.feature_4, l.feature_5
  FROM base b LEFT JOIN customer c ON c.c_custkey = b.userid
  LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS feature_3, ROUND(AVG(l_discount), 6) AS feature_4,
                    CAST(COUNT(*) AS DOUBLE) AS feature_5
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = b.id)"""
)

ARMS_SQL = "arms AS (SELECT CAST(UNNEST([3,4,5,6,7,8,9,10]) AS INT) AS arm)"

LONG_SQL = (
    BASE_SQL
    + ", "
    + ARMS_SQL
    + """,
long AS (
  SELECT a.arm, s.id, CASE WHEN s.treatment > 0 THEN 1 ELSE 0 END AS treatment, s.label,
         CAST((s.id * (31 + a.arm)) % 997 AS DOUBLE) / 997 - 0.5 AS uplift
  FROM base s JOIN arms a ON s.treatment = 0 OR s.treatment = a.arm)"""
)

GMV_SQL = """
gmv AS (
  SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ancestor_order_create_dt,
         o_totalprice AS pay_gmv_d1
  FROM orders)"""

DAILY_SQL = (
    GMV_SQL
    + """,
daily AS (
  SELECT CAST(ancestor_order_create_dt AS DATE) AS dt, SUM(pay_gmv_d1) AS label
  FROM gmv GROUP BY 1)"""
)

PRICE_SQL = """
price AS (
  SELECT CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS plan_date, p.p_brand AS dim_prd_brand,
         CASE WHEN l.l_extendedprice / l.l_quantity < 1400 THEN 'low'
              WHEN l.l_extendedprice / l.l_quantity < 3000 THEN 'mid' ELSE 'high' END AS price_level,
         l.l_partkey AS pid
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""

REP_SQL = """
rep AS (
  SELECT vec_id AS id, embedding AS x, CAST(vec_id % 2 AS INT) AS t,
         CASE WHEN label > 1 THEN 1 ELSE 0 END AS y
  FROM embeddings)"""

CALENDAR_SQL = (
    "cal AS (SELECT * FROM (VALUES "
    + ", ".join(f"({y}, DATE '{d}')" for y, d in CALENDAR.items())
    + ") AS v(year, fest))"
)


def hash_sql(id_sql: str, seed_sql: str = "0") -> str:
    """The engine's hash as SQL."""
    text = f"CAST({id_sql} AS VARCHAR) || '|' || CAST({seed_sql} AS VARCHAR)"
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def hash01_sql(id_sql: str, seed_sql: str = "0") -> str:
    return f"(CAST({hash_sql(id_sql, seed_sql)} AS DOUBLE) / {16**15}.0)"


PSM_SQL = (
    BASE_SQL
    + """,
psm AS (
  SELECT id, userid, treatment, label, rct_mark, """
    + ", ".join(f"CASE WHEN id % 97 <> {a} THEN {hash01_sql('id', str(40 + a))} END AS ps_score_{a}" for a in ARMS)
    + " FROM base)"
)


def r(expr: str, digits: int, name: str) -> str:
    """Rounded SQL column without negative zero."""
    return f"CASE WHEN ROUND({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE ROUND({expr}, {digits}) END AS {name}"
