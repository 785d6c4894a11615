"""Rates, evidence scoring, the action lattice and confidence arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from triagelake import config as C


def rate(numerator: Column, denominator: Column) -> Column:
    """Null, never zero, when there is nothing to divide by."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def resolve_peer(conversation_type: Column, business_id: Column, sender_user_id: Column) -> tuple[Column, Column]:
    business = conversation_type == "business"
    kind = F.when(business, F.lit("business")).otherwise(F.lit("user"))
    peer = F.nullif(F.when(business, business_id).otherwise(sender_user_id), F.lit(""))
    return kind, peer


def event_relevance(opened, replied, dismissed, muted_after, reported) -> Column:
    """Strongest recorded reaction; no event counts as zero."""
    weights = C.EVENT_RELEVANCE
    flags = {
        "reported": reported, "muted_after": muted_after, "replied": replied,
        "dismissed": dismissed, "opened": opened,
    }
    terms = [F.when(flag, F.lit(weights[name])).otherwise(F.lit(0.0)) for name, flag in flags.items()]
    return F.greatest(*terms)


def evidence_score(same_peer, lexical, same_group, event, recency) -> Column:
    """Weighted mean of the five terms; a null similarity counts as zero here only."""
    return (
        C.W_SAME_PEER * same_peer.cast("double")
        + C.W_LEXICAL * F.coalesce(lexical, F.lit(0.0))
        + C.W_SAME_GROUP * same_group.cast("double")
        + C.W_EVENT * event
        + C.W_RECENCY * recency
    )


def severity(action: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in C.ACTIONS]), action).cast("int")


def toward_mute(current: Column, proposed: Column) -> Column:
    """The more suppressed of two actions; a null proposal changes nothing."""
    moved = F.greatest(severity(current), severity(proposed))
    return F.element_at(F.array(*[F.lit(a) for a in C.ACTIONS]), moved)


def escalate_type(current: Column, proposed: Column) -> Column:
    """``scam`` is terminal."""
    return F.when(current == "scam", current).otherwise(F.coalesce(proposed, current))


def clamp_confidence(value: Column) -> Column:
    return F.bround(F.least(F.greatest(value, F.lit(C.CONF_FLOOR)), F.lit(C.CONF_CEIL)), 2)


def calibrate_confidence(reported, media_mismatch, first_contact_without_evidence, hard_blocked) -> Column:
    value = reported - F.when(media_mismatch, F.lit(C.MEDIA_MISMATCH_PENALTY)).otherwise(F.lit(0.0))
    value = value - F.when(first_contact_without_evidence, F.lit(C.FIRST_CONTACT_PENALTY)).otherwise(F.lit(0.0))
    value = F.when(hard_blocked, F.least(value, F.lit(C.HARD_BLOCK_CONFIDENCE))).otherwise(value)
    return clamp_confidence(value)


def composite(action, type_, evidence_f1, reason_quality, calibration_error) -> Column:
    w = C.COMPOSITE_WEIGHTS
    terms = (
        w["action"] * action, w["type"] * type_, w["evidence"] * evidence_f1,
        w["reason"] * F.coalesce(reason_quality, F.lit(0.0)),
        w["calibration"] * (F.lit(1.0) - calibration_error),
    )
    return reduce(lambda a, b: a + b, terms)


def token_cost(inputs, outputs, cache_read, cache_write, input_rate, output_rate) -> Column:
    """Price of one model's tokens; null rates leave it unpriced."""
    billable = inputs + cache_read * C.CACHE_READ_MULTIPLIER + cache_write * C.CACHE_WRITE_MULTIPLIER
    return (billable * input_rate + outputs * output_rate) / F.lit(1000000.0)
