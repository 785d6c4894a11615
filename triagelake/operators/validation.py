"""Staged validation of supplied decisions: schema, vocabulary, invariants, style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from triagelake import config as C
from triagelake.functions.reasons import REPAIRABLE_CODES, reason_issues
from triagelake.functions.vocab import coerce_vocabulary, lookup, media_mismatch, parse_confidence, parse_evidence_strict

# Fixed value: fields every decision must carry.
REQUIRED_FIELDS = (
    "action", "message_type", "reason", "confidence", "evidence_message_ids",
    "risk_axis", "relevance_axis", "urgency_axis",
)
_NUMERIC = ("BIGINT", "DOUBLE")


def _codes(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks]))


#: Fields of a payload that are read.
_FIELDS = (*REQUIRED_FIELDS, "deadline_minutes", "material_harm", "media_observation",
           "media_observation.corroborates_message_claim", "media_observation.mismatch_reason")


def _named(kind: str, name: str) -> str:
    return f"_{kind}_{name.replace('.', '_')}"


def _field(name: str) -> Column:
    return F.col(_named("field", name))


def _kind(name: str) -> Column:
    return F.col(_named("kind", name))


def _as(name: str, kind: str) -> Column:
    return F.try_variant_get(_field(name), "$", kind)


def _text(name: str) -> Column:
    """Value of a JSON string; null for any other type."""
    return F.when(_kind(name) == "STRING", _as(name, "string"))


def _is_numeric(name: str) -> Column:
    return _kind(name).isin(*_NUMERIC) | F.startswith(_kind(name), F.lit("DECIMAL"))


def parse_decisions(raw: DataFrame) -> DataFrame:
    """Typed columns plus ``schema_codes`` from one JSON payload per message.

    The mismatch flag and sentence come from the recorded observation, so a payload never
    states them twice.
    """
    v = raw.withColumn("_p", F.try_parse_json("payload"))
    broken = ~F.coalesce(F.startswith(F.schema_of_variant("_p"), F.lit("OBJECT")), F.lit(False))
    # Anything but an object counts as one without fields.
    v = v.withColumn("_v", F.when(broken, F.parse_json(F.lit("{}"))).otherwise(F.col("_p")))
    # Each field is looked up once, and so is its type.
    v = v.withColumns({_named("field", f): F.try_variant_get(F.col("_v"), f"$.{f}", "variant") for f in _FIELDS})
    v = v.withColumns({_named("kind", f): F.schema_of_variant(_field(f)) for f in _FIELDS})
    number = _as("confidence", "double")
    confidence = F.when(_kind("confidence") == "STRING", parse_confidence(_text("confidence"))).when(
        _is_numeric("confidence") & number.between(0.0, 1.0), number
    )
    observed = F.startswith(_kind("media_observation"), F.lit("OBJECT"))
    has_deadline = _kind("deadline_minutes").isNotNull() & (_kind("deadline_minutes") != "VOID")
    # A whole number beyond 64 bits is the latest deadline there is.
    huge = _kind("deadline_minutes").rlike(r"^DECIMAL\(\d+,0\)$")
    sign = F.signum(_as("deadline_minutes", "double"))
    deadline = F.when(huge, F.when(sign < 0, F.lit(-1)).otherwise(F.lit((1 << 63) - 1))).otherwise(
        _as("deadline_minutes", "long"))
    typed = v.select(
        *[c for c in raw.columns if c != "payload"],
        broken.alias("_broken"),
        _codes([(_field(f).isNull(), "missing_field") for f in REQUIRED_FIELDS]).alias("_missing"),
        _text("action").alias("raw_action"), _text("message_type").alias("raw_type"), _text("reason").alias("reason"),
        confidence.alias("confidence"), parse_evidence_strict(_text("evidence_message_ids")).alias("cited"),
        _text("risk_axis").alias("risk_axis"), _text("relevance_axis").alias("relevance_axis"),
        _text("urgency_axis").alias("urgency_axis"),
        F.coalesce(observed & media_mismatch(_text("media_observation.corroborates_message_claim")), F.lit(False)).alias("media_mismatch"),
        F.when(observed, _text("media_observation.mismatch_reason")).alias("media_mismatch_reason"),
        (_kind("media_observation").isNotNull() & (_kind("media_observation") != "VOID")).alias("has_observation"),
        F.when(has_deadline, deadline).alias("deadline_minutes"),
        (has_deadline & ((~huge & (_kind("deadline_minutes") != "BIGINT")) | (deadline < 0))).alias("_bad_deadline"),
        F.coalesce(_as("material_harm", "boolean"), F.lit(False)).alias("material_harm"),
        (_field("material_harm").isNotNull() & (_kind("material_harm") != "BOOLEAN")).alias("_bad_harm"),
    )
    bad = _codes([
        (F.col("reason").isNull(), "invalid_reason"),
        (F.col("confidence").isNull(), "invalid_confidence"),
        (F.col("cited").isNull(), "invalid_evidence_format"),
        (F.col("risk_axis").isNull() | ~F.col("risk_axis").isin(*C.RISK_AXES), "invalid_risk_axis"),
        (F.col("relevance_axis").isNull() | ~F.col("relevance_axis").isin(*C.RELEVANCE_AXES), "invalid_relevance_axis"),
        (F.col("urgency_axis").isNull() | ~F.col("urgency_axis").isin(*C.URGENCY_AXES), "invalid_urgency_axis"),
        (F.col("_bad_deadline"), "invalid_deadline_minutes"),
        (F.col("_bad_harm"), "invalid_material_harm"),
    ])
    codes = F.when(F.col("_broken"), F.array(F.lit("invalid_object"))).when(F.size("_missing") > 0, F.col("_missing")).otherwise(bad)
    return typed.withColumn("schema_codes", codes).drop("_broken", "_missing", "_bad_deadline", "_bad_harm")


def coerce_labels(parsed: DataFrame) -> DataFrame:
    """Canonical action and type, the codes of failed fields, and how many were repaired."""
    out = parsed.withColumns({
        "_action": coerce_vocabulary(F.col("raw_action"), C.ACTIONS),
        "_type": coerce_vocabulary(F.col("raw_type"), C.MESSAGE_TYPES),
    })
    failed = []
    for column, field in (("_action", "action"), ("_type", "message_type")):
        for tier in ("invalid", "ambiguous"):
            failed.append((F.col(f"{column}.tier") == tier, f"{tier}_{field}"))
    repaired = sum(F.col(f"{c}.tier").isin("normalised", "token_subset").cast("int") for c in ("_action", "_type"))
    schema_ok = F.size("schema_codes") == 0
    return out.withColumns({
        "action": F.col("_action.value"), "message_type": F.col("_type.value"),
        "coercion_codes": F.when(schema_ok, _codes(failed)).otherwise(F.array().cast("array<string>")),
        "coercion_count": F.when(schema_ok, repaired).otherwise(0),
    }).drop("_action", "_type")


def check_invariants(coerced: DataFrame) -> DataFrame:
    """Cross-field rules against the offered evidence.

    ``evidence`` is the ranked candidate list of the message. Inspection rules apply only
    where ``inspected_media_ids`` is supplied.
    """
    offered = F.transform("evidence", lambda e: e["history_message_id"])
    out = coerced.withColumns({
        "evidence_ids": F.filter("cited", lambda c: F.array_contains(offered, c)),
        "dropped_ids": F.filter("cited", lambda c: ~F.array_contains(offered, c)),
    })
    kept = F.col("evidence_ids")
    negative = F.exists(
        "evidence",
        lambda e: F.array_contains(kept, e["history_message_id"]) & (e["dismissed"] | e["muted_after"] | e["reported"]),
    )
    readable = (F.col("media_type") == "image") & F.col("media_id").isNotNull() & F.col("file_exists") & F.col("inspected_media_ids").isNotNull()
    opened = F.array_contains("inspected_media_ids", F.col("media_id"))
    checks = [
        (readable & ~opened, "I7"),
        (readable & opened & ~F.col("has_observation"), "I8"),
        (F.col("risk_axis").isin("unsafe", "scam_or_unsafe") & ((F.col("action") != "mute") | ~F.col("message_type").isin("scam", "spam")), "I1"),
        ((F.col("action") == "notify") & (F.col("urgency_axis") == "none"), "I2"),
        (F.col("relevance_axis").isin("low", "unwanted") & (F.col("action") == "mute") & (F.col("risk_axis") == "clean") & ~negative, "I3"),
        ((F.size(kept) == 0) & (F.size("evidence") > 0), "I5"),
        (F.size(kept) > C.MAX_EVIDENCE_IDS, "I6"),
    ]
    return out.withColumn("invariant_codes", _codes(checks))


def judge(row: DataFrame) -> DataFrame:
    """Stage, codes and the canonical decision beside the columns of ``row``.

    ``row`` holds the columns of ``parse_decisions`` and of the message: evidence,
    media_type, media_id, file_exists and inspected_media_ids. Everything is a column
    expression, so a run needs one join between decisions and features. ``stage`` is null
    for an accepted decision; a row without any decision keeps null ``schema_codes``.
    """
    out = check_invariants(coerce_labels(row)).withColumn("style_codes", reason_issues(F.col("reason")))
    stages = (("schema", "schema"), ("coercion", "coercion"), ("invariant", "invariants"), ("style", "reason_style"))
    stage = codes = None
    for name, label in stages:
        bad, found = F.size(f"{name}_codes") > 0, F.col(f"{name}_codes")
        stage = F.when(bad, label) if stage is None else stage.when(bad, label)
        codes = F.when(bad, found) if codes is None else codes.when(bad, found)
    empty = F.array().cast("array<string>")
    out = out.withColumns({"stage": stage, "codes": F.coalesce(codes, empty)})
    reached = F.coalesce(F.col("stage").isin("invariants", "reason_style"), F.lit(True))
    shape_only = F.size(F.array_except("codes", F.array(*[F.lit(c) for c in REPAIRABLE_CODES]))) == 0
    return out.withColumns({
        "dropped_ids": F.when(reached, F.coalesce("dropped_ids", empty)).otherwise(empty),
        "repairable": F.coalesce((F.col("stage") == "reason_style") & shape_only, F.lit(False)),
        "risk": lookup(F.col("risk_axis"), C.RISK_AXES), "relevance": lookup(F.col("relevance_axis"), C.RELEVANCE_AXES),
        "urgency": F.col("urgency_axis"),
    }).drop("coercion_codes", "invariant_codes", "style_codes", "raw_action", "raw_type", "cited", "risk_axis",
            "relevance_axis", "urgency_axis", "has_observation")


def validate_decisions(raw: DataFrame, context: DataFrame) -> DataFrame:
    """Validated decision or the first failing stage, one row per payload.

    ``context`` carries message_id, evidence, media_type, media_id, file_exists and
    optionally inspected_media_ids.
    """
    seen = F.col("inspected_media_ids") if "inspected_media_ids" in context.columns else F.lit(None).cast("array<string>")
    facts = context.select("message_id", "evidence", "media_type", "media_id", "file_exists", seen.alias("inspected_media_ids"))
    out = judge(parse_decisions(raw).join(facts, "message_id"))
    return out.drop("evidence", "media_type", "media_id", "file_exists", "inspected_media_ids", "schema_codes")
