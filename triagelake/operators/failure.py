"""What ships when a supplied decision is rejected: a repaired sentence or a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from triagelake import config as C
from triagelake.functions import detectors as D
from triagelake.functions.reasons import humanise, passes_contract, percent, plural, quote_clean
from triagelake.functions.text import guard_text

# --- Fixed values: sentences. --------------------------------------------------------
GENERIC_REASON = (
    "This message is held for the digest because no usable decision was recorded against "
    "the sender's history."
)
NO_DECISION = " was not decided against the sender's history before the attempt ended, so it is held for the digest."
BAD_SHAPE = " came back in a shape the sender's history checks cannot accept, so it is held for the digest."
BAD_INVARIANT = " came back with a decision its own cited history did not support, so it is held for the digest."
BAD_STYLE = " came back with a reason naming nothing observable in the sender's history, so it is held for the digest."
FLOOR_SENTENCE = (
    "No earlier history from this sender was retained for this recipient, so this message "
    "was decided on its own content."
)
# --- End of fixed values. ------------------------------------------------------------


def fallback_type() -> Column:
    """Coarse type from the recall-grade signals of the row."""
    return (
        F.when(F.col("credential_request").isNotNull() | F.col("injection_match").isNotNull(), "scam")
        .when(F.col("brand_verdict") == "impersonation", "scam")
        .when(F.col("payment_pressure").isNotNull(), "payment")
        .when(F.col("is_forwarded"), "forward")
        .when(F.col("conversation_type") == "business", "business_update")
        .when(F.col("conversation_type") == "personal", "personal")
        .otherwise("unknown")
    )


def _named(prefix: str, joiner: str, name: Column) -> Column:
    return F.when(F.length(name) > 0, F.concat(F.lit(prefix + joiner), name)).otherwise(prefix)


def fallback_reason(outcome: Column, stage: Column) -> Column:
    """Describe the message and what failed, or the generic sentence if that breaks style."""
    account = F.coalesce(F.nullif(F.col("brand_name"), F.lit("")), F.col("display_name"))
    who = (
        F.when(F.col("conversation_type") == "business", _named("A business notice", " from ", account))
        .when(F.col("conversation_type") == "group",
              F.when(F.col("has_group"), F.concat(F.lit("A group message in "), F.col("group_name"))).otherwise("A group message"))
        .otherwise(_named("A personal message", " from ", F.col("display_name")))
    )
    media = F.when(F.col("media_type") == "voice", " with a voice note").when(
        F.col("media_type") == "image", " with an image attachment").otherwise("")
    rejected = outcome == "validation_rejected"
    clause = (
        F.when(rejected & stage.isin("schema", "coercion"), BAD_SHAPE)
        .when(rejected & (stage == "invariants"), BAD_INVARIANT)
        .when(rejected & (stage == "reason_style"), BAD_STYLE)
        .otherwise(NO_DECISION)
    )
    sentence = F.concat(who, media, clause)
    # A one-element array names the sentence once.
    return F.get(F.transform(F.array(sentence), lambda s: F.when(passes_contract(s), s).otherwise(GENERIC_REASON)), F.lit(0))


def fallback_columns(outcome: Column, stage: Column) -> dict[str, Column]:
    """A full conservative decision for one dossier row."""
    empty = F.array().cast("array<string>")
    top = F.when(F.size("evidence") > 0, F.array(F.col("evidence")[0]["history_message_id"])).otherwise(empty)
    return {
        "action": F.lit("digest"), "message_type": fallback_type(), "reason": fallback_reason(outcome, stage),
        "confidence": F.lit(C.CONF_FLOOR), "evidence_ids": top, "risk": F.lit("clean"), "relevance": F.lit("medium"),
        "urgency": F.lit("none"), "media_mismatch": F.lit(False), "media_mismatch_reason": F.lit(None).cast("string"),
        "deadline_minutes": F.lit(None).cast("int"), "material_harm": F.lit(False), "coercion_count": F.lit(0),
    }


def with_repair_phrases(row: DataFrame, needed: Column | None = None) -> DataFrame:
    """Precision phrases of the *normalised* text, which is what a repaired sentence quotes.

    Rows outside ``needed`` are not scanned and get nulls.
    """
    text = F.col("normalised_text") if needed is None else F.when(needed, F.col("normalised_text"))
    staged = row.withColumn("_g", guard_text(text))
    return staged.withColumns({
        "repair_credential": D.asks_for_credential(F.col("_g")),
        "repair_injection": D.looks_like_injection(F.col("_g")),
        "repair_payment": D.demands_payment(F.col("_g")),
    }).drop("_g")


def repair_reason() -> Column:
    """First true statement about the row that keeps the style contract.

    Reads dossier columns, ``with_repair_phrases`` and the decision's action and type.
    """
    col, lit = F.col, F.lit
    n, opens = col("peer_n"), col("peer_open_rate")
    seen = opens.isNotNull() & (n > 0)
    brand = F.when(F.length("brand_name") > 0, col("brand_name")).otherwise("this business")
    # Candidate sentences, most decisive first in each group.
    adverse = F.array(
        F.when(col("repair_credential").isNotNull(), F.concat(
            lit('A request for a credential worded "'), quote_clean(col("repair_credential")),
            lit('" decided this message ahead of any standing the sender has.'))),
        F.when(col("repair_injection").isNotNull(), F.concat(
            lit('Text trying to dictate its own delivery with "'), quote_clean(col("repair_injection")),
            lit('" was recorded as evidence against this sender.'))),
        F.when(col("repair_payment").isNotNull(), F.concat(
            lit('A demand for payment worded "'), quote_clean(col("repair_payment")),
            lit('" decided this message against the sender\'s history.'))),
        F.when(col("brand_verdict") == "impersonation", F.concat(
            lit("A sender domain that does not match the official "), brand, lit(" domain, with "),
            plural(col("user_reports_30d"), "user report"), lit(", decided this notice."))),
        F.when(col("opted_out") & (col("message_type") == "promotion"), lit(
            "A promotion from a business whose promotions this user has already opted out of decided this message.")),
        F.when((col("peer_dismiss_rate") >= 0.5) & (n > 0), F.concat(
            lit("This recipient dismissed "), percent(col("peer_dismiss_rate")), lit(" of the "),
            plural(n, "previous message"), lit(" from this sender."))),
        F.when(col("duplicate_count") > 0, F.concat(
            lit("This message repeats "), plural(col("duplicate_count"), "earlier message"),
            lit(" from the same sender in the retained history."))),
        F.when(col("is_forwarded"), F.concat(
            lit("This message arrived as a forward with a hop count of "), col("forwarded_count").cast("string"),
            lit(", which decided it against the sender's history."))),
    )
    supporting = F.array(
        F.when(col("deadline_minutes").isNotNull() & seen, F.concat(
            lit("The message states a deadline and this recipient opens "), percent(opens), lit(" of the "),
            plural(n, "previous message"), lit(" from this sender."))),
        F.when(col("has_group") & (col("sender_role") == "admin"), F.concat(
            lit("A group admin in "), col("group_name"), lit(" sent this notice"),
            F.when(seen, F.concat(lit(" and this recipient opens "), percent(opens), lit(" of them"))).otherwise(""), lit("."))),
        F.when(col("has_business") & (F.length("biz_why_user_knows_account") > 0), F.concat(
            lit("A business notice matching this recipient's "), humanise(col("biz_why_user_knows_account")),
            lit(" decided this message, from an account"),
            F.when(seen, F.concat(lit(" opened "), percent(opens), lit(" of the time"))).otherwise(""), lit("."))),
        F.when(seen, F.concat(
            lit("This recipient opens "), percent(opens), lit(" of the "), plural(n, "previous message"),
            lit(" from this sender."))),
    )
    quoted = col("repair_credential").isNotNull() | col("repair_injection").isNotNull() | col("repair_payment").isNotNull()
    ordered = F.when((col("action") == "notify") & ~quoted, F.concat(supporting, adverse)).otherwise(F.concat(adverse, supporting))
    # Sentences behind the first that passes are not looked at.
    first = F.aggregate(ordered, lit(None).cast("string"), lambda found, s: F.when(
        found.isNull() & s.isNotNull() & passes_contract(s), s).otherwise(found))
    return F.coalesce(first, lit(FLOOR_SENTENCE))


def settle(judged: DataFrame) -> DataFrame:
    """Accepted, repaired or fallback decision on every row of ``validation.judge``.

    Shape-only style failures keep the decision and get a new sentence; any other failure,
    and a message with no decision at all, gets the fallback.
    """
    has_row = F.col("schema_codes").isNotNull()
    outcome = (
        F.when(has_row & F.col("stage").isNull(), "submitted").when(has_row & F.col("repairable"), "reason_repaired")
        .when(has_row, "validation_rejected").otherwise("no_decision")
    )
    row = judged.withColumn("outcome", outcome)
    row = with_repair_phrases(row, F.col("outcome") == "reason_repaired").withColumns({
        "failure_reason": F.when(F.col("stage").isNotNull(), F.concat(F.col("stage"), F.lit(": "), F.array_join("codes", ","))),
        "rejected_reason": F.when(F.col("outcome") == "reason_repaired", F.col("reason")),
    })
    keeps = F.col("outcome").isin("submitted", "reason_repaired")
    fallback = fallback_columns(F.col("outcome"), F.col("stage"))
    fixed = {name: F.when(keeps, F.col(name)).otherwise(value) for name, value in fallback.items()}
    fixed["reason"] = (
        F.when(F.col("outcome") == "submitted", F.col("reason"))
        .when(F.col("outcome") == "reason_repaired", repair_reason()).otherwise(fallback["reason"])
    )
    return row.withColumns(fixed)
