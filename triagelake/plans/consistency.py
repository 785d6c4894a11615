"""Do near-duplicate messages get the same action, and if not, what explains it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triagelake import config as C
from triagelake.operators import divergence as V
from triagelake.operators.similarity import near_duplicate_clusters
from triagelake.session import cut_lineage

# Dossier columns that may justify different outcomes: no text, ids, names or dates.
EXPLAINING = (
    ["conversation_type", "peer_kind", "category", "verified", "official_domain", "domain_used_by_sender",
     "domain_mismatch", "account_age_days", "domain_used_by_sender_age_days", "user_reports_30d", "brand_verdict",
     "verdict_basis", "evidence_state"]
    + [f"{p}_{c}" for p in ("peer", "global") for c in (
        "n", "open_rate", "reply_rate", "dismiss_rate", "mute_rate", "report_rate", "n_reacted", "median_reaction_minutes")]
    + [f"baseline_{c}" for c in (
        "messages_opened_30d", "messages_replied_30d", "notifications_dismissed_30d", "messages_reported_30d",
        "notifications_sent_30d", "notifications_dismissed_total", "n_summary_days", "dismiss_rate", "mean_daily_notifications")]
    + ["group_type", "member_count", "admin_count", "group_messages_30d", "user_role", "sender_role", "group_muted_by_user",
       "user_messages_sent_30d", "user_messages_read_30d", "user_replies_sent_30d", "user_notifications_dismissed_30d",
       "group_read_rate", "group_reply_rate", "group_dismiss_rate"]
    + ["biz_why_user_knows_account", "days_since_last_activity", "biz_allows_promotions", "opted_out",
       "biz_activity_count_180d", "biz_messages_opened_30d", "biz_messages_dismissed_30d", "biz_messages_replied_30d", "open_share"]
    + ["dnd_window_raw", "in_dnd", "minutes_until_dnd_ends"]
)


def message_clusters(messages: DataFrame, threshold: float = C.CLUSTER_MIN_JACCARD) -> DataFrame:
    """Near-duplicate clusters of ``messages`` (message_id, message_text, position), kept as a checkpoint."""
    texts = messages.select(F.col("message_id").alias("id"), F.col("message_text").alias("text"), "position")
    return cut_lineage(near_duplicate_clusters(texts, threshold))


def clustered_members(messages: DataFrame, actions: DataFrame, features: DataFrame, threshold: float = C.CLUSTER_MIN_JACCARD,
                      clusters: DataFrame | None = None) -> DataFrame:
    """cluster_number, id, action and features of every clustered message with an action.

    ``features`` has message_id and ``features``. ``clusters`` are those of ``message_clusters``, worked out if not given.
    """
    clusters = message_clusters(messages, threshold) if clusters is None else clusters
    acted = actions.select(F.col("message_id").alias("id"), "action").filter("action IS NOT NULL")
    mapped = features.select(F.col("message_id").alias("id"), "features")
    return clusters.join(acted, "id").join(mapped, "id").select("cluster_number", "id", "action", "features")


def consistency_report(messages, actions, features, threshold: float = C.CLUSTER_MIN_JACCARD, clusters: DataFrame | None = None) -> dict[str, DataFrame]:
    """summary, clusters, features, witnesses and missing predictions; reports on the same messages can share ``clusters``."""
    members = cut_lineage(clustered_members(messages, actions, features, threshold, clusters))
    clusters = V.cluster_divergence(members)
    summary = clusters.agg(
        F.count("*").alias("cluster_count"), F.coalesce(F.sum("divergent_pairs"), F.lit(0)).alias("divergent_pairs"),
        F.coalesce(F.sum("unexplained_pairs"), F.lit(0)).alias("bug_pairs"))
    return {
        "summary": summary, "clusters": clusters, "features": V.feature_divergence(members),
        "witnesses": V.divergence_witnesses(members),
        "missing": messages.select("message_id").join(actions.select("message_id"), "message_id", "left_anti"),
    }


def dossier_features(dossier: DataFrame) -> DataFrame:
    return dossier.select("message_id", V.feature_map(EXPLAINING).alias("features"))
