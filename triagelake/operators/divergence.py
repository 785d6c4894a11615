"""Different outcomes inside near-duplicate clusters, counted without listing pairs.

The number of member pairs whose actions differ, whose actions differ while every feature
agrees, and whose actions differ while one given feature agrees, all follow from group
sizes. Each is exact and costs one pass, also when a cluster holds a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def feature_map(columns: list[str]) -> Column:
    """name -> text of each feature; nulls are kept as null values."""
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in columns]),
    )


def feature_differences(left: Column, right: Column) -> Column:
    """Sorted names over both maps whose values differ; absent equals null."""
    differs = F.map_zip_with(left, right, lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(differs, lambda k, d: d)))


def _divergent(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Pairs with different actions inside each group of ``keys``."""
    n = F.col("n").cast("decimal(38,0)")
    per_action = groups.groupBy(*keys, "action").agg(F.count("*").alias("n"))
    pairs = (F.sum(n) * F.sum(n) - F.sum(n * n)) / 2
    return per_action.groupBy(*keys).agg(pairs.cast("long").alias(name))


def cluster_divergence(members: DataFrame) -> DataFrame:
    """Per cluster: members, divergent pairs, and pairs no feature explains.

    ``members`` has cluster_number, id, action and ``features`` (a map).
    """
    signed = members.withColumn("_sig", F.sha2(F.to_json("features", {"ignoreNullFields": "false"}), 256))
    size = members.groupBy("cluster_number").agg(F.count("*").alias("n_members"))
    total = _divergent(signed, ["cluster_number"], "divergent_pairs")
    same = _divergent(signed, ["cluster_number", "_sig"], "pairs").groupBy("cluster_number").agg(
        F.sum("pairs").alias("unexplained_pairs"))
    return size.join(total, "cluster_number").join(same, "cluster_number")


def feature_divergence(members: DataFrame) -> DataFrame:
    """Per cluster and feature: divergent pairs in which that feature differs."""
    total = _divergent(members, ["cluster_number"], "divergent_pairs").filter("divergent_pairs > 0")
    values = members.select("cluster_number", "action", F.explode("features").alias("feature", "value"))
    agree = _divergent(values, ["cluster_number", "feature", "value"], "pairs").groupBy("cluster_number", "feature").agg(
        F.sum("pairs").alias("agreeing"))
    return agree.join(total, "cluster_number").select(
        "cluster_number", "feature", (F.col("divergent_pairs") - F.col("agreeing")).alias("differing_pairs"))


def divergence_witnesses(members: DataFrame) -> DataFrame:
    """For each member and each other action of its cluster, the smallest such member and
    the features that tell the two apart."""
    first = members.groupBy("cluster_number", F.col("action").alias("other_action")).agg(
        F.min_by(F.struct("id", "features"), "id").alias("w"))
    joined = members.join(first, "cluster_number").filter(F.col("action") != F.col("other_action"))
    return joined.select(
        "cluster_number", "id", "action", F.col("w.id").alias("other_id"), "other_action",
        feature_differences(F.col("features"), F.col("w.features")).alias("differing_features"),
    ).withColumn("is_bug", F.size("differing_features") == 0)
