"""The one-directional safety gate over validated decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from triagelake import config as C
from triagelake.config import DEFAULTS, Thresholds
from triagelake.functions import detectors as D
from triagelake.functions.reasons import passes_contract, percent, plural, quote_trim, restates
from triagelake.functions.scores import calibrate_confidence, clamp_confidence, escalate_type, severity, toward_mute
from triagelake.functions.text import guard_text, python_strip

# Rule names in evaluation order and the roles with standing in a group.
RULES = (
    "INJECTION", "CREDENTIAL_REQUEST", "BRAND_IMPERSONATION", "PAYMENT_PRESSURE_UNTRUSTED", "OPT_OUT",
    "BEHAVIOURAL_DEMOTION", "MEDIA_MISMATCH", "DND_INTERRUPTION_COST",
)
ADMIN_ROLES = ("admin", "owner")


def detect(messages: DataFrame) -> DataFrame:
    """Precision phrases of the raw text: ``attack_phrase``, ``credential_phrase``, ``payment_phrase``."""
    staged = messages.withColumn("_guarded", guard_text(F.col("message_text")))
    guarded = F.col("_guarded")
    return staged.withColumns({
        "attack_phrase": D.looks_like_injection(guarded),
        "credential_phrase": D.asks_for_credential(guarded),
        "payment_phrase": D.demands_payment(guarded),
    }).drop("_guarded")


def gate_facts(row: DataFrame) -> DataFrame:
    """Facts the rules read, from dossier columns, detected phrases and the decision."""
    return row.withColumns({
        "injection_phrase": F.coalesce("injection_match", "attack_phrase"),
        "sender_is_admin": F.coalesce(F.col("has_group") & F.col("sender_role").isin(*ADMIN_ROLES), F.lit(False)),
        "first_contact": F.col("peer_n") == 0,
        "first_contact_without_evidence": (F.col("evidence_state") == "none") & (F.size("evidence") == 0),
        "mismatch": F.col("media_type").isNotNull() & F.coalesce("media_mismatch", F.lit(False)),
        "unclean_brand": F.coalesce(F.col("brand_verdict") != "clean", F.lit(False)),
    })


def _listed(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def _brand_clause() -> Column:
    return F.when(F.col("unclean_brand"), F.concat(F.lit("a "), F.col("brand_verdict"), F.lit(" brand-integrity verdict")))


def _outcome(fires: Column, name: str, sentence: Column, action: Column, message_type: Column) -> Column:
    return F.when(F.coalesce(fires, F.lit(False)), F.struct(
        F.lit(name).alias("name"), sentence.alias("sentence"), action.cast("string").alias("action"),
        message_type.cast("string").alias("type"),
    ))


def rule_outcomes(t: Thresholds = DEFAULTS) -> Column:
    """Array of what the first seven rules contribute, in order, each judged on its own."""
    col, lit, mute, scam, none = F.col, F.lit, F.lit("mute"), F.lit("scam"), F.lit(None)
    untrusted = _listed(
        _brand_clause(),
        F.when(col("peer_report_rate") > 0, F.concat(lit("a "), percent(col("peer_report_rate")), lit(" report rate with this user"))),
        F.when(col("first_contact"), lit("no prior contact with this user")),
        F.when(~col("sender_is_admin"), lit("no admin standing in this channel")),
    )
    escalators = _listed(
        F.when(col("payment_phrase").isNotNull(), lit("a payment demand")),
        F.when(col("credential_phrase").isNotNull(), lit("a credential request")),
        _brand_clause(),
    )
    escalated = escalators != ""
    detail = F.when(col("media_mismatch_reason").isNotNull(),
                    F.concat(lit(" ("), quote_trim(col("media_mismatch_reason")), lit(")"))).otherwise("")
    brand = F.when(F.length("brand_name") > 0, col("brand_name")).otherwise("this business")
    # The sentence each rule may put into the reason.
    rules = (
        (col("injection_phrase").isNotNull(),
         F.concat(lit('The message text tries to dictate its own delivery with "'), quote_trim(col("injection_phrase")),
                  lit('", which is recorded as evidence rather than followed.')), mute, scam),
        (col("credential_phrase").isNotNull(),
         F.concat(lit('The message asks the user to hand over a credential with "'), quote_trim(col("credential_phrase")),
                  lit('", which no legitimate sender does.')), mute, scam),
        (col("brand_verdict") == "impersonation",
         F.concat(lit("The sender fails all five brand-integrity checks for "), brand,
                  lit(", including a mismatched sender domain and "), plural(F.coalesce("user_reports_30d", lit(0)), "user report"),
                  lit(f" against {t.brand_max_reports} tolerated.")), mute, scam),
        (col("payment_phrase").isNotNull() & (untrusted != ""),
         F.concat(lit('The message demands payment with "'), quote_trim(col("payment_phrase")), lit('" from a sender with '),
                  untrusted, lit(".")), mute, scam),
        (col("opted_out") & (col("message_type") == "promotion"),
         F.concat(lit("The user opted out of promotions from this business on "),
                  F.date_format("biz_promotions_opted_out_at", "yyyy-MM-dd"), lit(" and this message is promotional.")),
         mute, lit("promotion")),
        ((col("peer_dismiss_rate") >= t.dismiss_mute_threshold) & (col("peer_n") >= t.min_peer_history)
         & (col("risk") == "clean") & (col("urgency") != "immediate") & ~col("sender_is_admin"),
         F.concat(lit("This user dismisses "), percent(col("peer_dismiss_rate")), lit(" of the "),
                  plural(col("peer_n"), "previous message"), lit(" from this sender.")), mute, none),
        (col("mismatch"),
         F.when(escalated, F.concat(lit("The attachment does not support the message text and arrives alongside "), escalators, lit(".")))
         .otherwise(F.concat(lit("The attachment does not support the message text"), detail,
                             lit(", which lowers confidence in this routing."))),
         F.when(escalated, mute), F.when(escalated, scam)),
    )
    return F.array_compact(F.array(*[_outcome(f, n, s, a, k) for n, (f, s, a, k) in zip(RULES, rules)]))


def quiet_hours_outcome() -> Column:
    """Rule 8, judged on the action the safety rules left."""
    live = F.coalesce(F.col("deadline_minutes") < F.col("minutes_until_dnd_ends"), F.lit(False))
    window = F.when(F.length("dnd_window_raw") > 0, F.col("dnd_window_raw")).otherwise("configured")
    fires = (F.col("_safe_action") == "notify") & F.col("in_dnd") & ~F.col("material_harm") & ~live
    sentence = F.concat(
        F.lit("The message arrived inside the user's "), window,
        F.lit(" do-not-disturb window and carries no deadline that closes before the window ends."),
    )
    return _outcome(fires, RULES[7], sentence, F.lit("digest"), F.lit(None))


def apply_gate(row: DataFrame, t: Thresholds = DEFAULTS, quiet_hours: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Final decision plus its audit trace.

    ``row`` holds one validated decision per message beside its dossier columns and the
    phrases of ``detect``; its ``keep`` columns are passed on. Everything is a column
    expression over that one row.
    """
    staged = gate_facts(row).withColumn("_rules", rule_outcomes(t))
    has_mute = F.exists("_rules", lambda o: F.coalesce(o["action"] == "mute", F.lit(False)))
    staged = staged.withColumns({
        "hard_blocked": has_mute,
        "_safe_action": toward_mute(F.col("action"), F.when(has_mute, "mute").otherwise("notify")),
        "final_type": F.aggregate("_rules", F.col("message_type"), lambda acc, o: escalate_type(acc, o["type"])),
    })
    quiet = quiet_hours_outcome() if quiet_hours else F.lit(None).cast(staged.schema["_rules"].dataType.elementType)
    staged = staged.withColumn("_quiet", quiet)
    staged = staged.withColumns({
        "_outcomes": F.when(F.col("_quiet").isNull(), F.col("_rules")).otherwise(F.concat("_rules", F.array("_quiet"))),
        "final_action": F.when(F.col("_quiet").isNotNull(), toward_mute(F.col("_safe_action"), F.lit("digest"))).otherwise(F.col("_safe_action")),
        "final_confidence": calibrate_confidence(
            F.col("confidence"), F.col("mismatch"), F.col("first_contact_without_evidence"), F.col("hard_blocked")),
    })
    deciding = F.try_element_at(F.filter("_outcomes", lambda o: o["action"].isNotNull()), F.lit(1))
    staged = staged.withColumns({
        "action_changed": F.col("final_action") != F.col("action"),
        "_authored": python_strip(F.col("reason")),
        "_sentence": deciding["sentence"],
    })
    silent_rule = restates(F.col("_sentence"), F.col("_authored")) | ~passes_contract(F.col("_sentence"))
    reason = (
        F.when(F.col("_sentence").isNull(), F.col("_authored"))
        .when(F.col("action_changed"), F.col("_sentence"))
        .when(silent_rule, F.col("_authored"))
        .otherwise(F.col("_sentence"))
    )
    staged = staged.withColumn("final_reason", reason)
    silent = F.filter("_outcomes", lambda o: ~F.contains(F.col("final_reason"), o["sentence"]))
    return staged.select(
        "message_id", *keep, F.col("final_action").alias("action"), F.col("final_type").alias("message_type"),
        F.col("final_reason").alias("reason"), F.col("final_confidence").alias("confidence"), "evidence_ids",
        F.transform("_outcomes", lambda o: o["name"]).alias("rules_fired"),
        F.struct(
            F.col("action").alias("_pre_gate_action"), F.col("message_type").alias("_pre_gate_message_type"),
            F.col("confidence").alias("_pre_gate_confidence"), F.col("reason").alias("_pre_gate_reason"),
            F.col("risk").alias("_pre_gate_risk"), F.col("relevance").alias("_pre_gate_relevance"),
            F.col("urgency").alias("_pre_gate_urgency"), F.col("final_action").alias("_post_gate_action"),
            F.col("final_type").alias("_post_gate_message_type"), F.col("final_confidence").alias("_post_gate_confidence"),
            F.transform("_outcomes", lambda o: o["name"]).alias("_gate_rules_fired"),
            F.col("action_changed").alias("_gate_action_changed"), F.col("hard_blocked").alias("_gate_hard_blocked"),
            F.col("media_mismatch_reason").alias("_media_mismatch_reason"),
            F.transform(silent, lambda o: o["name"]).alias("_gate_sentences_suppressed"),
            F.bround(F.col("final_confidence") - clamp_confidence(F.col("confidence")), 2).alias("_gate_confidence_delta"),
            F.col("in_dnd").alias("_dnd_in_window"), F.col("minutes_until_dnd_ends").alias("_dnd_minutes_remaining"),
            F.lit(quiet_hours).alias("_dnd_modifier_enabled"),
        ).alias("gate_trace"),
    )


def gate_violations(final: DataFrame) -> DataFrame:
    """Rows that moved toward notify or raised the clamped confidence; must be empty."""
    trace = F.col("gate_trace")
    return final.filter(
        (severity(F.col("action")) < severity(trace["_pre_gate_action"]))
        | (F.col("confidence") > clamp_confidence(trace["_pre_gate_confidence"]) + 1e-9)
    )


def assert_one_directional(final: DataFrame) -> DataFrame:
    """Same rows, failing the job on the first violation."""
    trace = F.col("gate_trace")
    fine = (severity(F.col("action")) >= severity(trace["_pre_gate_action"])) & (
        F.col("confidence") <= clamp_confidence(trace["_pre_gate_confidence"]) + 1e-9)
    checked = F.when(fine, F.col("action")).otherwise(
        F.raise_error(F.concat(F.lit("gate moved toward notify: "), F.col("message_id"))).cast("string"))
    return final.withColumn("action", checked)
