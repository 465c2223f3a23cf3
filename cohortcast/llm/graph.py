"""Connected components by stars, and spanning forests inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node of an edge; root is the smallest node it reaches.

    Rounds of large and small stars: every node hangs its larger neighbours, then its smaller ones,
    on the smallest it knows, until nothing moves. Each round is written, so lineage stays short;
    a node with very many edges is one row after map-side minima and a join key that Spark splits.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, last = stage(now, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last or not state.n:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(parent, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stage(hung.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stage(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops), "roots")


def forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number for each of 0..count-1, given links a-b."""
    root = np.arange(count)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (again := root[root]).tolist() != root.tolist():
            root = again
        if (root == before).all():
            break
    return root
