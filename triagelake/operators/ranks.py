"""Exact ranks without a stage that ends in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from triagelake.session import cut_lineage


def nearest_rank(rows: DataFrame, column: str, share: float) -> DataFrame:
    """One row ``value``: the smallest value that at least ``share`` of the values do not exceed.

    Distinct values are counted and range-partitioned; one number per partition tells which range
    holds the rank, and only that range is summed up in order. Nulls do not count; without values the
    row holds null.
    """
    counted = cut_lineage(
        rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        .repartitionByRange("value").withColumn("_p", F.spark_partition_id()))
    sizes = counted.groupBy("_p").agg(F.sum("n").alias("n"), F.min("value").alias("from")).orderBy("from").collect()
    target = math.ceil(share * sum(s["n"] for s in sizes) - 1e-9)
    before, held = 0, -1
    for size in sizes:
        held = size["_p"]
        if before + size["n"] >= target:
            break
        before += size["n"]
    inside = counted.where(F.col("_p") == held).withColumn("_sum", F.sum("n").over(Window.orderBy("value")) + before)
    return inside.where(F.col("_sum") >= target).agg(F.min("value").alias("value"))
