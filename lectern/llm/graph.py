"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = around.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    joined = around.join(lowest, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lowest.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge table (u, v), root the smallest node it
    reaches; loops are ignored. Each round is written to the shared folder; the driver sees counts.
    ``dropped`` may be called on the result."""
    state = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    seen = None
    while True:
        following = stored(_stars(_stars(state, True), False))
        dropped(state)
        state = following
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out._lectern_path = state._lectern_path
    return out
