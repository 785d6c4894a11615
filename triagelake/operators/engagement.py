"""Engagement of a recipient with a sender, as of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triagelake import config as C
from triagelake.functions.scores import rate, resolve_peer
from triagelake.operators.running import median_before, totals_before, with_micros

FLAGS = {
    "opened": "message_opened", "replied": "message_replied", "dismissed": "notification_dismissed",
    "muted_after": "muted_after_message", "reported": "message_reported",
}
RATES = {
    "open_rate": "opened", "reply_rate": "replied", "dismiss_rate": "dismissed",
    "mute_rate": "muted_after", "report_rate": "reported",
}


def with_peer(df: DataFrame) -> DataFrame:
    """Add ``peer_kind`` and ``peer_id``; blank senders have no peer."""
    kind, peer = resolve_peer(F.col("conversation_type"), F.col("business_id"), F.col("sender_user_id"))
    return df.withColumn("peer_kind", kind).withColumn("peer_id", peer)


def with_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """History rows with the reaction of their own recipient; absent events give false flags."""
    e = events.select(
        "user_id", "message_id", F.lit(True).alias("has_event"), "reaction_time_minutes",
        *[F.col(source).alias(name) for name, source in FLAGS.items()],
    )
    joined = history.join(e, ["user_id", "message_id"], "left")
    filled = {name: F.coalesce(F.col(name), F.lit(False)) for name in ["has_event", *FLAGS]}
    return joined.withColumns(filled)


def engagement_before(
    messages: DataFrame, history: DataFrame, keys: list[str], prefix: str, medians: bool = True, **scale
) -> DataFrame:
    """Rates per message over earlier history with the same ``keys``.

    ``messages`` and ``history`` carry ``peer_id`` and ``at_us``; ``history`` carries the
    event columns. Every message gets a row; one without history has n = 0 and null rates.
    """
    asked = messages.select("message_id", *keys, "at_us")
    # A message without a peer has no engagement and must not meet other null keys.
    known = asked.filter(F.col("peer_id").isNotNull())
    facts = history.filter(F.col("has_event") & F.col("peer_id").isNotNull()).select(
        *keys, "at_us", F.lit(1).alias("n"),
        F.col("reaction_time_minutes").isNotNull().cast("long").alias("n_reacted"),
        "reaction_time_minutes", *[F.col(f).cast("long").alias(f) for f in FLAGS],
    )
    measures = ["n", "n_reacted", *FLAGS]
    totals = totals_before(known, facts, keys, measures, **scale)
    if medians:
        # The number of reactions is among the totals, so the medians need no count of their own.
        totals = median_before(totals, facts, keys, "reaction_time_minutes", counted="n_reacted")
    result = totals.select(
        "message_id", F.col("n").alias(f"{prefix}n"), F.col("n_reacted").alias(f"{prefix}n_reacted"),
        *[rate(F.col(f), F.col("n")).alias(f"{prefix}{r}") for r, f in RATES.items()],
        *[F.col("median").alias(f"{prefix}median_reaction_minutes")] * medians,
    )
    out = asked.select("message_id").join(result, "message_id", "left")
    return out.fillna(0, [f"{prefix}n", f"{prefix}n_reacted"])


def sender_burst(messages: DataFrame, history: DataFrame, hours: int = C.BURST_WINDOW_HOURS, **scale) -> DataFrame:
    """Messages the recipient got from the same sender in the trailing window.

    Two running totals, at the message and at the start of its window; their difference
    is the count, so no pair of rows is ever formed.
    """
    span = hours * 3600 * 1000000
    asked = messages.select("message_id", "user_id", "peer_id", "at_us")
    edges = asked.filter(F.col("peer_id").isNotNull()).select(
        "message_id", "user_id", "peer_id",
        F.explode(F.array(
            F.struct(F.lit(1).alias("sign"), F.col("at_us")),
            F.struct(F.lit(-1).alias("sign"), (F.col("at_us") - span).alias("at_us")),
        )).alias("edge"),
    ).select("message_id", "user_id", "peer_id", "edge.sign", "edge.at_us")
    facts = history.filter(F.col("peer_id").isNotNull()).select("user_id", "peer_id", "at_us", F.lit(1).alias("n"))
    counts = (
        totals_before(edges, facts, ["user_id", "peer_id"], ["n"], **scale)
        .groupBy("message_id").agg(F.sum(F.col("sign") * F.col("n")).alias("sender_burst_24h"))
    )
    return asked.select("message_id").join(counts, "message_id", "left").fillna(0, ["sender_burst_24h"])


def evidence_state(peer_n, global_n):
    return F.when(peer_n > 0, "peer").when(global_n > 0, "global_fallback").otherwise("none")


# The sentence that states what a rate was computed over.
def peer_basis_note(n):
    return F.when(
        n > 0, F.concat(F.lit("Computed over "), n.cast("string"), F.lit(" earlier messages this user received from this sender."))
    ).otherwise(
        "This user has never received a message from this sender. No per-user rates exist; all rates below are null."
    )


def global_basis_note(n):
    return F.when(
        n > 0,
        F.concat(
            F.lit("FALLBACK — weaker evidence: this sender's behaviour across all "), n.cast("string"),
            F.lit(" messages it sent to any user, not to this user."),
        ),
    ).otherwise("FALLBACK unavailable: this sender does not appear anywhere in message history.")


def daily_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("user_id").agg(
        F.sum("notifications_sent").alias("notifications_sent_30d"),
        F.sum("notifications_dismissed").alias("notifications_dismissed_total"),
        F.count("*").alias("n_summary_days"),
    )


def prepare(df: DataFrame) -> DataFrame:
    return with_micros(with_peer(df))
