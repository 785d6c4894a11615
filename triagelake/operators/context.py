"""Group, business, media, timing and recipient context of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from triagelake.functions.scores import rate
from triagelake.functions.timewin import dnd_columns, whole_days_between
from triagelake.session import cut_lineage


def first_per_key(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Dimensions without a uniqueness contract are looked up by their first row."""
    values = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*values), F.col(position)).alias("_first")).select(key, "_first.*")


def user_baseline(users: DataFrame, daily: DataFrame) -> DataFrame:
    """Per user: 30-day counters and daily notification totals, zero where absent."""
    first = first_per_key(users, "user_id").drop("position")
    joined = first.join(daily, "user_id", "full")
    counters = [
        "messages_opened_30d", "messages_replied_30d", "notifications_dismissed_30d", "messages_reported_30d",
        "notifications_sent_30d", "notifications_dismissed_total", "n_summary_days",
    ]
    filled = joined.fillna(0, counters)
    return filled.select(
        "user_id", "do_not_disturb_window", *[F.col(c).alias(f"baseline_{c}") for c in counters],
        rate(F.col("notifications_dismissed_total"), F.col("notifications_sent_30d")).alias("baseline_dismiss_rate"),
        rate(F.col("notifications_sent_30d"), F.col("n_summary_days")).alias("baseline_mean_daily_notifications"),
    )


def with_baseline(messages: DataFrame, baseline: DataFrame) -> DataFrame:
    out = messages.join(baseline, "user_id", "left")
    counts = [c for c in baseline.columns if c.startswith("baseline_") and not c.endswith(("rate", "notifications"))]
    return out.fillna(0, counts)


def with_timing(messages: DataFrame) -> DataFrame:
    timing = dnd_columns(F.col("created_at"), F.col("do_not_disturb_window"))
    local = F.date_format("created_at", "HH:mm:ss.SSSSSS")
    return messages.withColumns({"local_time": local, **timing}).drop("do_not_disturb_window")


def group_context(messages: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Per group message: the group, the recipient's membership and the sender's role.

    Messages whose group or recipient membership is unknown have no row here.
    """
    asked = messages.filter((F.col("conversation_type") == "group") & F.col("group_id").isNotNull()).select(
        "message_id", "group_id", "user_id", "sender_user_id"
    )
    g = first_per_key(groups, "group_id").select(
        "group_id", "group_name", "group_type", "member_count", "admin_count",
        F.col("messages_30d").alias("group_messages_30d"),
    )
    receiver = members.select(
        "group_id", "user_id", F.col("role").alias("user_role"), "group_muted_by_user",
        F.col("messages_sent_30d").alias("user_messages_sent_30d"),
        F.col("messages_read_30d").alias("user_messages_read_30d"),
        F.col("replies_sent_30d").alias("user_replies_sent_30d"),
        F.col("notifications_dismissed_30d").alias("user_notifications_dismissed_30d"),
    )
    sender = members.select("group_id", F.col("user_id").alias("sender_user_id"), F.col("role").alias("sender_role"))
    joined = (
        asked.join(g, "group_id").join(receiver, ["group_id", "user_id"])
        .join(sender, ["group_id", "sender_user_id"], "left")
    )
    return joined.withColumns({
        "group_read_rate": rate(F.col("user_messages_read_30d"), F.col("group_messages_30d")),
        "group_reply_rate": rate(F.col("user_replies_sent_30d"), F.col("user_messages_read_30d")),
        "group_dismiss_rate": rate(F.col("user_notifications_dismissed_30d"), F.col("group_messages_30d")),
    }).drop("user_id", "sender_user_id")


def business_relationship(messages: DataFrame, relations: DataFrame) -> DataFrame:
    """Per business message with a recorded relationship between recipient and account."""
    asked = messages.filter((F.col("conversation_type") == "business") & F.col("business_id").isNotNull())
    joined = asked.select("message_id", "user_id", "business_id", "created_at").join(relations, ["user_id", "business_id"])
    return joined.withColumns({
        "days_since_last_activity": whole_days_between(F.col("created_at"), F.col("last_activity_at")),
        "opted_out": F.col("promotions_opted_out_at").isNotNull(),
        "open_share": rate(F.col("messages_opened_30d"), F.col("messages_opened_30d") + F.col("messages_dismissed_30d")),
    }).drop("user_id", "business_id", "created_at")


def media_context(messages: DataFrame, media: DataFrame) -> DataFrame:
    """Attachment of each message, looked up in the manifest of its own kind."""
    asked = messages.filter(F.col("media_type").isNotNull()).select("message_id", F.col("media_type").alias("kind"), "media_id")
    found = asked.join(media, ["kind", "media_id"], "left")
    return found.select(
        "message_id", "file_path", F.coalesce("file_exists", F.lit(False)).alias("file_exists"), "file_size_bytes",
    )


def latest_per_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Newest record of an append-only log per key."""
    values = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.col(sequence)).alias("_last")).select(key, "_last.*")


def ordered_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rank rows inside each key; used where file order or time order must be explicit.

    Rows are sorted over the whole table, so a key with very many rows lies in several parts: a rank is
    the place in a part and the rows of the key in the parts before it.
    """
    key = F.struct(*keys)
    placed = cut_lineage(df.repartitionByRange(*keys, *order).withColumns({"_part": F.spark_partition_id(), "_key": key}))
    in_part = Window.partitionBy("_key", "_part").orderBy(*order)
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_key", "_part").agg(F.count("*").alias("_n")).select(
        "_key", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("row_rank", F.row_number().over(in_part)).join(before, ["_key", "_part"])
    return ranked.withColumn("row_rank", (F.col("row_rank") + F.col("_before")).cast("int")).drop("_part", "_key", "_before")
