"""The feature row of each message, assembled from the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from triagelake.config import DEFAULTS, Thresholds
from triagelake.functions import scanners as S
from triagelake.functions.text import casefold, normalise_text, python_strip, url_domains
from triagelake.operators import context as X, engagement as E
from triagelake.operators.brand import brand_integrity
from triagelake.operators.retrieval import rank_history
from triagelake.operators.running import may_be_crowded
from triagelake.session import at_once, shared_dir
from triagelake.sources import driver_views
from triagelake.sources.bucketed import Reactions
from triagelake.sources.files import media_manifest, read_table


@dataclass
class Tables:
    """Source tables of one run. ``media`` has kind, media_id, path, presence and size."""

    messages: DataFrame
    history: DataFrame
    message_events: DataFrame
    users: DataFrame
    groups: DataFrame
    group_members: DataFrame
    business_accounts: DataFrame
    user_business_history: DataFrame
    daily_summary: DataFrame
    media: DataFrame

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        return cls(**{name: driver_views.load(spark, sf_dir, name) for name in cls.__dataclass_fields__})

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> "Tables":
        """The tables of a dataset folder, each under its contract; attachments lie in ``media``.

        A run reads most tables several times; each is parsed once and kept as a checkpoint. The tables are
        read side by side, because most of a reading is small jobs one after the other.
        """
        named = {"history": "message_history", "daily_summary": "daily_notification_summary"}
        shared_dir(spark)

        def parsed(name: str) -> DataFrame:
            return read_table(spark, f"{folder}/{named.get(name, name)}.csv", named.get(name, name))

        names = [name for name in cls.__dataclass_fields__ if name != "media"] + ["images", "voice_notes"]
        read = dict(zip(names, at_once(partial(parsed, name) for name in names)))
        images, voices = read.pop("images"), read.pop("voice_notes")
        return cls(**read, media=media_manifest(spark, images, voices, folder, "media"))

    def bucketed(self, folder: str) -> "Tables":
        """The same tables with history and events stored in buckets below ``folder``, for runs that read them again."""
        history, events = Reactions.store(self.history, self.message_events, folder).tables(self.history.sparkSession)
        return replace(self, history=history, message_events=events)


def content_signals(messages: DataFrame) -> DataFrame:
    """Text-derived columns of each message; scanners are null on unscanned text."""
    text = F.col("message_text")
    staged = messages.withColumns({"normalised_text": normalise_text(text), "folded_text": casefold(text)})
    words = F.col("normalised_text")
    scanned = F.length(words) > 0
    length = F.length(python_strip(text))
    return staged.withColumns({
        "text_length": length,
        "is_empty_text": length == 0,
        "text_scanned": scanned,
        "is_forwarded": F.col("forwarded_count") > 0,
        "url_domains": url_domains(text),
        "injection_match": F.when(scanned, S.scan_injection(words)),
        "credential_request": F.when(scanned, S.scan_credential(words)),
        "payment_pressure": F.when(scanned, S.scan_payment(words)),
        "is_promotional": S.is_promotional(F.col("folded_text")),
        "has_mention": S.has_direct_mention(F.col("folded_text")),
        "has_deadline": S.has_deadline(words),
        "keyword_type": S.keyword_type(F.col("folded_text"), F.col("conversation_type")),
    })


def sender_identity(messages: DataFrame, accounts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Account identity and brand verdict; null for senders that are not known businesses."""
    account = brand_integrity(accounts, t)
    asked = F.when(F.col("conversation_type") == "business", F.col("business_id"))
    return messages.withColumn("_account", asked).join(
        account.withColumnRenamed("business_id", "_account"), "_account", "left"
    ).drop("_account")


def enriched_history(t: Tables) -> DataFrame:
    return E.with_events(E.prepare(t.history), t.message_events)


def relationship(messages: DataFrame, history: DataFrame, medians: bool = True, crowded: bool | None = None) -> DataFrame:
    """Engagement with the sender, for this recipient and for everyone."""
    peer = E.engagement_before(messages, history, ["user_id", "peer_id"], "peer_", medians, crowded=crowded)
    overall = E.engagement_before(messages, history, ["peer_id"], "global_", medians, crowded=crowded)
    return peer.join(overall, "message_id").withColumns({
        "evidence_state": E.evidence_state(F.col("peer_n"), F.col("global_n")),
        "peer_basis_note": E.peer_basis_note(F.col("peer_n")),
        "global_basis_note": E.global_basis_note(F.col("global_n")),
    })


def build_dossier(t: Tables, thresholds: Thresholds = DEFAULTS, medians: bool = True, lists: bool = True) -> DataFrame:
    """One wide row per message.

    Recipient columns join on ``user_id``, account columns on ``business_id``; everything
    else is keyed by ``message_id`` and joined last, so the message side is shuffled once
    for all of those joins.
    """
    messages = E.prepare(t.messages)
    history = enriched_history(t)
    narrow = messages.select("message_id", "user_id", "peer_id", "at_us")
    row = content_signals(messages)
    row = sender_identity(row, t.business_accounts, thresholds)
    row = X.with_timing(X.with_baseline(row, X.user_baseline(t.users, E.daily_totals(t.daily_summary))))

    # One count for all running totals: a crowded slice of any finer key is one of its sender.
    crowded = may_be_crowded(narrow.select("peer_id", "at_us").unionByName(E.prepare(t.history).select("peer_id", "at_us")), "peer_id")
    sections = [relationship(narrow, history, medians, crowded), E.sender_burst(narrow, history, crowded=crowded)]
    if lists:
        sections.append(rank_history(messages, history))
    group = X.group_context(t.messages, t.groups, t.group_members)
    business = X.business_relationship(t.messages, t.user_business_history)
    prefixed = business.select("message_id", F.lit(True).alias("has_business"), *[
        F.col(c).alias(c if c in ("days_since_last_activity", "opted_out", "open_share") else f"biz_{c}")
        for c in business.columns if c != "message_id"
    ])
    sections += [group.drop("group_id").withColumn("has_group", F.lit(True)), prefixed, X.media_context(t.messages, t.media)]
    for section in sections:
        row = row.join(section, "message_id", "left")
    return row.withColumns({
        "has_group": F.coalesce("has_group", F.lit(False)),
        "has_business": F.coalesce("has_business", F.lit(False)),
        "file_exists": F.coalesce("file_exists", F.lit(False)),
        "requires_transcription": F.col("media_type").isNotNull(),
        "opted_out": F.coalesce("opted_out", F.lit(False)),
    })
