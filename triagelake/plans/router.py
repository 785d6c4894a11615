"""Rule-only routing and the threshold sweep."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from triagelake.config import DEFAULTS, SWEEP_VALUES, Thresholds
from triagelake.operators.brand import brand_verdict
from triagelake.operators import context as X, engagement as E
from triagelake.plans.dossier import Tables, content_signals, enriched_history, sender_identity


def routing_rule(t: Thresholds = DEFAULTS, verdict: Column | None = None) -> Column:
    """Name of the first rule that holds."""
    verdict = F.col("brand_verdict") if verdict is None else verdict
    return (
        F.when(F.col("injection_match").isNotNull(), "injection_match")
        .when(F.col("credential_request").isNotNull(), "credential_request")
        .when(verdict == "impersonation", "brand_impersonation")
        .when(F.col("opted_out") & F.col("is_promotional"), "promotion_opt_out")
        .when((F.col("peer_dismiss_rate") >= t.dismiss_mute_threshold) & (F.col("peer_n") >= t.min_peer_history), "peer_dismiss_rate")
        .when(F.col("has_mention") | F.col("has_deadline"), "attention_marker")
        .otherwise("default")
    )


def rule_action(rule: Column) -> Column:
    return F.when(rule == "attention_marker", "notify").when(rule == "default", "digest").otherwise("mute")


def rule_type(rule: Column) -> Column:
    return (
        F.when(rule.isin("injection_match", "credential_request", "brand_impersonation"), "scam")
        .when(rule == "promotion_opt_out", "promotion")
        .otherwise(F.col("keyword_type"))
    )


def routing_features(t: Tables, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Only what the rules read: no ranking, no medians, no recipient counters."""
    messages = E.prepare(t.messages)
    narrow = messages.select("message_id", "user_id", "peer_id", "at_us")
    row = sender_identity(content_signals(messages), t.business_accounts, thresholds)
    peer = E.engagement_before(narrow, enriched_history(t), ["user_id", "peer_id"], "peer_", medians=False)
    business = X.business_relationship(t.messages, t.user_business_history).select("message_id", "opted_out")
    row = row.join(peer, "message_id", "left").join(business, "message_id", "left")
    return row.withColumn("opted_out", F.coalesce("opted_out", F.lit(False)))


def route(features: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """message_id, action, message_type and the rule that decided."""
    rule = F.col("rule")
    return features.withColumn("rule", routing_rule(thresholds)).select(
        "message_id", rule_action(rule).alias("action"), rule_type(rule).alias("message_type"), "rule"
    )


def sweep(features: DataFrame, gold: DataFrame) -> DataFrame:
    """Accuracy of every one-at-a-time threshold setting, in one pass over the features.

    Each setting is a handful of conditional sums in the same aggregate, so neither the
    features nor the labels are multiplied by the grid.
    """
    settings = [(name, value) for name, values in SWEEP_VALUES.items() for value in values]
    joined = features.join(
        gold.select("message_id", F.col("action").alias("gold_action"), F.col("message_type").alias("gold_type")), "message_id"
    )
    known = F.col("verified").isNotNull()
    sums = [F.count("*").alias("total")]
    ruled = {}
    for i, (name, value) in enumerate(settings):
        t = replace(DEFAULTS, **{name: value})
        ruled[f"_rule{i}"] = routing_rule(t, F.when(known, brand_verdict(t)))
        rule = F.col(f"_rule{i}")
        action_ok = rule_action(rule) == F.col("gold_action")
        type_ok = rule_type(rule) == F.col("gold_type")
        sums += [
            F.count_if(action_ok).alias(f"a{i}"), F.count_if(type_ok).alias(f"t{i}"),
            F.count_if(action_ok & type_ok).alias(f"j{i}"),
        ]
    totals = joined.withColumns(ruled).agg(*sums)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("parameter"), F.lit(float(value)).alias("value"), "total",
            F.col(f"a{i}").alias("action_correct"), F.col(f"t{i}").alias("type_correct"), F.col(f"j{i}").alias("joint_correct"),
        ) for i, (name, value) in enumerate(settings)
    ]))
    flat = totals.select(rows.alias("r")).select("r.*")
    best = flat.groupBy("parameter").agg(F.max("action_correct").alias("_best"))
    return flat.join(best, "parameter").select(
        "parameter", "value", "total", "action_correct", "type_correct", "joint_correct",
        (F.col("action_correct") == F.col("_best")).alias("is_best"),
    )
