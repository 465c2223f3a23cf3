"""Queries for the general table operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (
    BASE_SQL,
    CALENDAR,
    CALENDAR_SQL,
    REP_SQL,
    SAMPLE_SQL,
    hash_sql,
    r,
    rep_sample,
    table,
    uplift_base,
    uplift_sample,
)
from catalog.registry import query, rnd
from cohortcast.functions import dates, scalars
from cohortcast.operators import checks, frames, sampling, series
from cohortcast.operators.ordering import equal_bins, lay_out


@query(
    "left_join_orders_customer",
    f"""SELECT o_orderkey, c_mktsegment AS segment, {r('c_acctbal', 2, 'balance')}
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def left_join_orders_customer(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").withColumnsRenamed(
        {"c_custkey": "o_custkey", "c_mktsegment": "segment", "c_acctbal": "balance"}
    )
    joined = table(spark, sf_dir, "orders").join(buyers, "o_custkey", "left")
    return joined.select("o_orderkey", "segment", rnd("balance", 2))


@query(
    "inner_join_days",
    """SELECT CAST(o.dt AS VARCHAR) AS dt, o.orders, s.lines
FROM (SELECT CAST(o_orderdate AS DATE) AS dt, COUNT(*) AS orders FROM orders GROUP BY 1) o
JOIN (SELECT CAST(l_shipdate AS DATE) AS dt, COUNT(*) AS lines FROM lineitem GROUP BY 1) s ON s.dt = o.dt""",
)
def inner_join_days(spark, sf_dir):
    def per_day(name: str, column: str, count: str):
        days = table(spark, sf_dir, name).groupBy(F.col(column).cast("date").alias("dt"))
        return days.agg(F.count(F.lit(1)).alias(count))

    both = per_day("orders", "o_orderdate", "orders").join(
        per_day("lineitem", "l_shipdate", "lines"), "dt"
    )
    return both.withColumn("dt", F.col("dt").cast("string"))


@query(
    "semi_join_fold",
    f"""WITH {BASE_SQL} SELECT id, treatment FROM base
WHERE userid IN (SELECT userid FROM base WHERE CAST({hash_sql('userid', '4')} % 4 AS INT) = 1)""",
)
def semi_join_fold(spark, sf_dir):
    rows = uplift_base(spark, sf_dir)
    fold = sampling.user_folds(rows, "userid", 4, 4).filter("fold = 1").select("userid").distinct()
    return rows.join(fold, "userid", "left_semi").select("id", "treatment")


@query(
    "mark_filters",
    f"""WITH {BASE_SQL}
SELECT rct_mark, treatment > 0 AS treated, COUNT(*) AS n FROM base GROUP BY ALL""".replace(
        "treatment > 0 AS treated", "CAST(treatment > 0 AS INT) AS treated"
    ),
)
def mark_filters(spark, sf_dir):
    rows = uplift_base(spark, sf_dir)
    parts = [
        rows.filter((F.col("rct_mark") == mark) & (F.col("treatment") > 0)) for mark in (0, 1)
    ] + [rows.filter((F.col("rct_mark") == mark) & (F.col("treatment") == 0)) for mark in (0, 1)]
    united = frames.unite(parts).withColumn("treated", scalars.treated_flag("treatment"))
    return united.groupBy("rct_mark", "treated").agg(F.count(F.lit(1)).alias("n"))


@query(
    "multi_key_sort_topn",
    f"""SELECT o_orderkey, o_orderpriority AS priority, {r('o_totalprice', 2, 'price')}
FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100""",
)
def multi_key_sort_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    order = [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return frames.top_rows(rows, 100, order).select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"), rnd("o_totalprice", 2, "price")
    )


@query(
    "topn_per_group",
    f"""SELECT o_orderpriority AS priority, o_orderkey, {r('o_totalprice', 2, 'price')} FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5""",
)
def topn_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return frames.top_rows(rows, 5, order, ["o_orderpriority"]).select(
        F.col("o_orderpriority").alias("priority"), "o_orderkey", rnd("o_totalprice", 2, "price")
    )


@query(
    "dedup_keep_first",
    """SELECT o_custkey, o_orderpriority AS priority, MIN(o_orderkey) AS o_orderkey
FROM orders GROUP BY 1, 2""",
)
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    first = frames.keep_first(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"])
    return first.select("o_custkey", F.col("o_orderpriority").alias("priority"), "o_orderkey")


@query(
    "nearest_entry",
    f"""SELECT o_custkey, {r('MIN(ABS(o_totalprice - 100000))', 2, 'distance')} FROM orders GROUP BY 1""",
)
def nearest_entry(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn(
        "distance", F.abs(F.col("o_totalprice") - F.lit(100000))
    )
    return frames.nearest_entry(rows, "o_custkey", "distance").select(
        "o_custkey", rnd("distance", 2)
    )


@query(
    "union_by_name",
    f"""SELECT key, {r('balance', 2, 'balance')}, segment FROM (
  SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier)""",
)
def union_by_name(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    sellers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key")
    )
    both = frames.unite([buyers, sellers], allow_missing=True)
    return both.select("key", rnd("balance", 2), "segment")


@query(
    "union_distinct_ids",
    "SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT l_suppkey FROM lineitem",
)
def union_distinct_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return frames.unite_ids(
        [
            lines.select(F.col("l_partkey").alias("id")),
            table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")),
            lines.select(F.col("l_suppkey").alias("id")),
        ],
        "id",
    )


@query(
    "null_counts",
    f"WITH {SAMPLE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS nulls FROM sample"
        for c in ("id", "userid", "treatment", "label", "rct_mark", *[f"feature_{i}" for i in range(1, 6)])
    ),
)
def null_counts(spark, sf_dir):
    return checks.null_counts(uplift_sample(spark, sf_dir))


@query(
    "fill_empty_string",
    f"""WITH {SAMPLE_SQL}
SELECT CAST(id AS VARCHAR) AS id, CAST(treatment AS VARCHAR) AS treatment,
       COALESCE(CAST(CAST(feature_5 AS BIGINT) AS VARCHAR), '') AS lines FROM sample""",
)
def fill_empty_string(spark, sf_dir):
    rows = uplift_sample(spark, sf_dir).select(
        "id", "treatment", F.col("feature_5").cast("long").alias("lines")
    )
    return frames.as_text(rows)


@query(
    "lookup_map",
    f"""SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation
ON n_nationkey = c_nationkey * 2""",
)
def lookup_map(spark, sf_dir):
    """Keys from 25 on have no nation."""
    customers = table(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey") * 2)
    nations = table(spark, sf_dir, "nation")
    found = frames.look_up(customers, "key", nations, "n_nationkey", "n_name", "nation")
    return found.select("c_custkey", "nation")


@query(
    "near_festival_days",
    f"""WITH {CALENDAR_SQL}
SELECT o_orderkey, CAST(fest AS VARCHAR) AS near_day FROM orders
JOIN cal ON ABS(fest - CAST(o_orderdate AS DATE)) <= 21""",
)
def near_festival_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("dt")
    )
    near = frames.near_days(rows, "dt", CALENDAR)
    return near.select("o_orderkey", F.col("near_day").cast("string").alias("near_day"))


@query(
    "clean_names",
    "SELECT o_orderkey AS _order_key_, o_orderstatus AS state_of_order FROM orders",
)
def clean_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("(order,key)"), F.col("o_orderstatus").alias("state of/order")
    )
    return series.clean_names(rows)


@query(
    "name_groups",
    "SELECT o_orderkey, o_totalprice AS y1_real FROM orders",
)
def name_groups(spark, sf_dir):
    """Feature and label columns picked by name."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "y1_real")
    features, labels = series.feature_and_label_columns(
        rows, "o_orderstatus", "y", ["o_custkey", "o_orderdate", "o_orderpriority"]
    )
    return rows.select(*features, *labels)


@query(
    "day_range",
    """WITH span AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders)
SELECT CAST(CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS dt FROM span""",
)
def day_range(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    span = table(spark, sf_dir, "orders").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return dates.day_range(span, "lo", "hi").select(F.col("dt").cast("string").alias("dt"))


@query(
    "percentile_labels",
    """WITH binned AS (SELECT NTILE(7) OVER (ORDER BY o_totalprice, o_orderkey) AS bin FROM orders)
SELECT CAST(bin AS INT) AS bin,
       ['0-14', '14-29', '29-43', '43-57', '57-71', '71-86', '86-100'][bin] AS label, COUNT(*) AS n
FROM binned GROUP BY bin""",
)
def percentile_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    binned = equal_bins(lay_out(rows, "o_totalprice", "o_orderkey", descending=False), 7)
    return binned.groupBy("bin", scalars.percentile_label("bin", 7).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "date_text",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
       strftime(CAST(o_orderdate AS DATE) + 1, '%d.%m.%Y') AS next_day,
       substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS first_ten FROM orders""",
)
def date_text(spark, sf_dir):
    day = F.col("o_orderdate")
    text = dates.day_text(day)
    next_day = F.date_add(dates.text_day(text), 1)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.alias("day_text"),
        dates.day_text(next_day, "dd.MM.yyyy").alias("next_day"),
        dates.first_ten(day).alias("first_ten"),
    )


@query(
    "date_lists",
    """SELECT o_custkey, CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day,
       COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1""",
)
def date_lists(spark, sf_dir):
    """A customer's order days as texts, parsed as a list."""
    texts = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", dates.day_text("o_orderdate").alias("text"))
        .distinct()
        .groupBy("o_custkey")
        .agg(F.collect_list("text").alias("texts"))  # at most one text per calendar day
    )
    days = dates.text_days("texts")
    return texts.select(
        "o_custkey", F.array_min(days).cast("string").alias("first_day"),
        F.size(days).cast("long").alias("days"),
    )


@query(
    "text_functions",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word,
       CAST(starts_with(p_type, 'ECONOMY') AS INT) AS economy, replace(p_brand, '#', '_') AS brand,
       regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants FROM part""",
)
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.split("p_name", " ")[0].alias("first_word"),
        F.col("p_type").startswith("ECONOMY").cast("int").alias("economy"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"),
        F.regexp_replace("p_name", "[aeiou]", "").alias("consonants"),
    )


@query(
    "scalar_functions",
    f"""SELECT c_custkey, {r('ABS(c_acctbal)', 2, 'size')},
       {r('1 / (1 + EXP(-c_acctbal / 1000))', 8, 'p')},
       CAST(1 / (1 + EXP(-c_acctbal / 1000)) > 0.5 AS INT) AS positive,
       {r('10 / (1 + EXP(-2 * c_acctbal / 10000)) + 1 - 5', 8, 'weight')} FROM customer""",
)
def scalar_functions(spark, sf_dir):
    balance = F.col("c_acctbal")
    p = scalars.sigmoid(balance / 1000)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", rnd(F.abs(balance), 2, "size"), rnd(p, 8, "p"),
        scalars.over_threshold(p).alias("positive"),
        rnd(scalars.growth_weight(balance / 10000), 8, "weight"),
    )


@query(
    "vector_functions",
    f"""WITH {REP_SQL}, d AS (SELECT id, CAST(x AS DOUBLE[]) AS x FROM rep)
SELECT id, {r('SQRT(list_dot_product(x, x))', 8, 'norm')},
       {r('EXP(x[1]) / list_sum(list_transform(x, lambda v: EXP(v)))', 8, 'first_share')} FROM d""",
)
def vector_functions(spark, sf_dir):
    return rep_sample(spark, sf_dir).select(
        "id", rnd(scalars.norm("x"), 8, "norm"), rnd(scalars.softmax("x")[0], 8, "first_share")
    )
