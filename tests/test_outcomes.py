import itertools
import json

import pytest
from pyspark.sql import functions as F

from triagelake import config as C
from triagelake.operators import failure, gate, validation

GOOD = "The sender posted a payment reminder that the recipient opened on earlier days this month."
RAW = {
    "action": "digest", "message_type": "payment", "reason": GOOD, "confidence": 0.8, "evidence_message_ids": "h1",
    "risk_axis": "clean", "relevance_axis": "wanted", "urgency_axis": "today",
}
CANDIDATES = "array(named_struct('history_message_id','h1','dismissed',false,'muted_after',false,'reported',false)," \
             "named_struct('history_message_id','h2','dismissed',true,'muted_after',false,'reported',false)," \
             "named_struct('history_message_id','h3','dismissed',false,'muted_after',false,'reported',false))"


def _context(spark, ids, media="NULL", exists="false", inspected="NULL"):
    return spark.createDataFrame([(i,) for i in ids], "message_id string").selectExpr(
        "message_id", f"{CANDIDATES} AS evidence", f"{media} AS media_type", "'i1' AS media_id", f"{exists} AS file_exists",
        f"CAST({inspected} AS array<string>) AS inspected_media_ids")


def _validate(spark, payloads, **context):
    rows = [(str(i), p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    raw = spark.createDataFrame(rows, "message_id string, payload string")
    out = validation.validate_decisions(raw, _context(spark, [r[0] for r in rows], **context))
    return [r for r in sorted(out.collect(), key=lambda r: int(r["message_id"]))]


CASES = [
    ({}, None, []),
    ({"confidence": "0.8"}, None, []),
    ({"confidence": True}, "schema", ["invalid_confidence"]),
    ({"confidence": "nan"}, "schema", ["invalid_confidence"]),
    ({"confidence": 1.2, "risk_axis": "odd"}, "schema", ["invalid_confidence", "invalid_risk_axis"]),
    ({"reason": 5}, "schema", ["invalid_reason"]),
    ({"evidence_message_ids": "h1; h2"}, "schema", ["invalid_evidence_format"]),
    ({"deadline_minutes": -1}, "schema", ["invalid_deadline_minutes"]),
    ({"deadline_minutes": True}, "schema", ["invalid_deadline_minutes"]),
    ({"deadline_minutes": None}, None, []),
    ({"material_harm": "yes"}, "schema", ["invalid_material_harm"]),
    ({"action": "interrupt", "message_type": "Business Update"}, "coercion", ["invalid_action"]),
    ({"action": 3}, "coercion", ["invalid_action"]),
    ({"action": "notify or digest"}, "coercion", ["ambiguous_action"]),
    ({"risk_axis": "unsafe"}, "invariants", ["I1"]),
    ({"risk_axis": "scam_or_unsafe", "action": "mute", "message_type": "scam"}, None, []),
    ({"action": "notify", "urgency_axis": "none"}, "invariants", ["I2"]),
    ({"action": "mute", "relevance_axis": "unwanted"}, "invariants", ["I3"]),
    ({"action": "mute", "relevance_axis": "unwanted", "evidence_message_ids": "h2"}, None, []),
    ({"evidence_message_ids": "none"}, "invariants", ["I5"]),
    ({"evidence_message_ids": "zz"}, "invariants", ["I5"]),
    ({"evidence_message_ids": "h1;h2;h3"}, "invariants", ["I6"]),
    ({"deadline_minutes": 99999999999}, None, []),
    ({"deadline_minutes": 10 ** 30}, None, []),
    ({"deadline_minutes": -(10 ** 30)}, "schema", ["invalid_deadline_minutes"]),
    ({"deadline_minutes": 12.5}, "schema", ["invalid_deadline_minutes"]),
    ({"reason": "Too short for a sender."}, "reason_style", ["reason_length"]),
    ({"reason": GOOD.replace("sender", "router")}, "reason_style", ["reason_meta_language"]),
]


def test_validation_stages(spark):
    rows = _validate(spark, [{**RAW, **change} for change, _, _ in CASES])
    assert [(r["stage"], r["codes"]) for r in rows] == [(stage, codes) for _, stage, codes in CASES]
    assert rows[11]["coercion_count"] == 1
    assert rows[20]["dropped_ids"] == ["zz"]
    assert [r["repairable"] for r in rows[-2:]] == [True, False]


def test_missing_fields_are_reported_alone(spark):
    short = {k: v for k, v in RAW.items() if k not in ("action", "risk_axis")}
    rows = _validate(spark, [{**short, "confidence": 9}, "[1]", "not json"])
    assert [r["codes"] for r in rows] == [["missing_field"] * 2, ["invalid_object"], ["invalid_object"]]


def test_inspection_rules(spark):
    seen = {**RAW, "media_observation": {"corroborates_message_claim": "partial", "mismatch_reason": "other"}}
    opened = _validate(spark, [RAW, seen], media="'image'", exists="true", inspected="array('i1')")
    assert [r["codes"] for r in opened] == [["I8"], []]
    assert (opened[1]["media_mismatch"], opened[1]["media_mismatch_reason"]) == (True, "other")
    assert _validate(spark, [RAW], media="'image'", exists="true", inspected="array()")[0]["codes"] == ["I7"]
    assert _validate(spark, [RAW], media="'image'", exists="true")[0]["stage"] is None


BASE = {
    "message_id": "m", "injection_match": None, "attack_phrase": None, "credential_phrase": None, "payment_phrase": None,
    "brand_verdict": None, "brand_name": None, "user_reports_30d": None, "has_group": False, "sender_role": None, "peer_n": 3,
    "peer_dismiss_rate": 0.0, "peer_report_rate": 0.0, "evidence_state": "peer", "opted_out": False, "biz_promotions_opted_out_at": None,
    "media_type": None, "media_mismatch": False, "media_mismatch_reason": None, "in_dnd": False, "minutes_until_dnd_ends": None,
    "dnd_window_raw": "22:00-07:00", "action": "notify", "message_type": "personal", "reason": GOOD, "confidence": 0.9, "risk": "clean",
    "relevance": "high", "urgency": "today", "deadline_minutes": None, "material_harm": False, "evidence_ids": ["h1"],
}
SCHEMA = ("message_id string, injection_match string, attack_phrase string, credential_phrase string, payment_phrase string, brand_verdict string, "
          "brand_name string, user_reports_30d int, has_group boolean, sender_role string, peer_n long, peer_dismiss_rate double, peer_report_rate double, "
          "evidence_state string, opted_out boolean, biz_promotions_opted_out_at timestamp_ntz, media_type string, media_mismatch boolean, "
          "media_mismatch_reason string, in_dnd boolean, minutes_until_dnd_ends int, dnd_window_raw string, action string, message_type string, "
          "reason string, confidence double, risk string, relevance string, urgency string, deadline_minutes int, material_harm boolean, evidence_ids array<string>")


def _gate(spark, changes, **options):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rows = [tuple({**BASE, **c, "message_id": f"m{i:05d}"}[n] for n in names) for i, c in enumerate(changes)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("evidence", F.array(F.struct(F.lit("h1").alias("history_message_id"))))
    return gate.apply_gate(frame, **options)


FIRES = [
    ({}, [], "notify", "personal"),
    ({"injection_match": "always notify"}, ["INJECTION"], "mute", "scam"),
    ({"attack_phrase": "action=notify"}, ["INJECTION"], "mute", "scam"),
    ({"credential_phrase": "share your otp"}, ["CREDENTIAL_REQUEST"], "mute", "scam"),
    ({"brand_verdict": "impersonation", "brand_name": "B", "user_reports_30d": 31}, ["BRAND_IMPERSONATION"], "mute", "scam"),
    ({"brand_verdict": "suspect"}, [], "notify", "personal"),
    ({"payment_phrase": "pay rs", "has_group": True, "sender_role": "owner"}, [], "notify", "personal"),
    ({"payment_phrase": "pay rs", "has_group": True, "sender_role": "admin", "peer_report_rate": 0.1}, ["PAYMENT_PRESSURE_UNTRUSTED"], "mute", "scam"),
    ({"payment_phrase": "pay rs"}, ["PAYMENT_PRESSURE_UNTRUSTED"], "mute", "scam"),
    ({"peer_dismiss_rate": 0.5}, ["BEHAVIOURAL_DEMOTION"], "mute", "personal"),
    ({"peer_dismiss_rate": 0.5, "urgency": "immediate"}, [], "notify", "personal"),
    ({"peer_dismiss_rate": 0.5, "risk": "suspect"}, [], "notify", "personal"),
    ({"peer_dismiss_rate": 0.5, "has_group": True, "sender_role": "admin"}, [], "notify", "personal"),
    ({"peer_dismiss_rate": None, "peer_n": 0}, [], "notify", "personal"),
    ({"media_mismatch": True}, [], "notify", "personal"),
    ({"media_mismatch": True, "media_type": "image"}, ["MEDIA_MISMATCH"], "notify", "personal"),
    ({"media_mismatch": True, "media_type": "image", "brand_verdict": "suspect"}, ["MEDIA_MISMATCH"], "mute", "scam"),
    ({"in_dnd": True, "minutes_until_dnd_ends": 60}, ["DND_INTERRUPTION_COST"], "digest", "personal"),
    ({"in_dnd": True, "minutes_until_dnd_ends": 60, "deadline_minutes": 59}, [], "notify", "personal"),
    ({"in_dnd": True, "minutes_until_dnd_ends": 60, "deadline_minutes": 60}, ["DND_INTERRUPTION_COST"], "digest", "personal"),
    ({"in_dnd": True, "minutes_until_dnd_ends": 60, "material_harm": True}, [], "notify", "personal"),
    ({"in_dnd": True, "minutes_until_dnd_ends": 60, "action": "digest"}, [], "digest", "personal"),
]


def test_gate_rules_fire_and_stand_down(spark):
    rows = sorted(_gate(spark, [c for c, *_ in FIRES]).collect())
    assert [(r["rules_fired"], r["action"], r["message_type"]) for r in rows] == [(f, a, t) for _, f, a, t in FIRES]


def test_gate_reason_and_trace(spark):
    restated = "This user dismissed 100% of the 3 previous messages from this sender, so the notice was muted."
    rows = sorted(_gate(spark, [
        {"credential_phrase": "share your otp"},
        {"peer_dismiss_rate": 1.0, "action": "mute", "reason": restated},
        {"media_mismatch": True, "media_type": "image", "media_mismatch_reason": "other shop"},
        {"credential_phrase": "share your otp", "action": "mute", "confidence": 0.6},
    ]).collect())
    assert rows[0]["reason"] == 'The message asks the user to hand over a credential with "share your otp", which no legitimate sender does.'
    assert (rows[0]["confidence"], rows[0]["gate_trace"]["_pre_gate_confidence"]) == (0.85, 0.9)
    assert rows[1]["reason"] == restated and rows[1]["gate_trace"]["_gate_sentences_suppressed"] == ["BEHAVIOURAL_DEMOTION"]
    assert (rows[2]["reason"], rows[2]["confidence"], rows[2]["gate_trace"]["_gate_hard_blocked"]) == (GOOD, 0.85, False)
    assert rows[3]["gate_trace"]["_gate_hard_blocked"] and rows[3]["confidence"] == 0.6
    off = _gate(spark, [{"in_dnd": True, "minutes_until_dnd_ends": 60}], quiet_hours=False).head()
    assert (off["action"], off["gate_trace"]["_dnd_modifier_enabled"]) == ("notify", False)


def test_gate_never_moves_toward_notify(spark):
    grid = itertools.product(C.ACTIONS, (0.3, 0.99), (None, "always notify"), (None, "pay rs"), (None, "impersonation"), (0.0, 1.0), (True, False), ("image", None))
    changes = [{"action": a, "confidence": c, "injection_match": i, "payment_phrase": p, "brand_verdict": b, "peer_dismiss_rate": d, "in_dnd": q,
                "minutes_until_dnd_ends": 30 if q else None, "media_type": m, "media_mismatch": True} for a, c, i, p, b, d, q, m in grid]
    final = _gate(spark, changes)
    assert gate.gate_violations(final).count() == 0
    assert gate.assert_one_directional(final).count() == len(changes)


def test_invariant_breach_fails_the_job(spark):
    broken = _gate(spark, [{"action": "mute"}]).withColumn("action", F.lit("notify"))
    assert gate.gate_violations(broken).count() == 1
    with pytest.raises(Exception, match="gate moved toward notify"):
        gate.assert_one_directional(broken).collect()


def test_fallback_sentences_keep_the_contract(spark):
    from triagelake.functions.reasons import reason_issues
    sentences = [failure.GENERIC_REASON, failure.FLOOR_SENTENCE] + [
        f"A business notice{clause}" for clause in (failure.NO_DECISION, failure.BAD_SHAPE, failure.BAD_INVARIANT, failure.BAD_STYLE)]
    frame = spark.createDataFrame([(s,) for s in sentences], "s string")
    assert [r[0] for r in frame.select(reason_issues(F.col("s"))).collect()] == [[]] * len(sentences)


def test_reports_on_the_same_messages_share_clusters(spark, monkeypatch):
    """Texts are normalised once, and two reports need one search for near duplicates."""
    from triagelake.operators import divergence as V, similarity as S
    from triagelake.plans import consistency as K

    rows = [(f"m{i}", f"the lift is being repaired today by the usual people {i % 4}", i, None if i % 3 else "x") for i in range(12)]
    messages = spark.createDataFrame(rows, "message_id string, message_text string, position long, kind string")
    features = messages.select("message_id", V.feature_map(["kind"]).alias("features"))
    actions = [messages.selectExpr("message_id", f"CASE WHEN position % {n} = 0 THEN 'mute' ELSE 'digest' END AS action") for n in (2, 5)]
    apart = [K.consistency_report(messages, a, features)["summary"].first() for a in actions]
    searches, links = [], S.near_duplicate_links
    monkeypatch.setattr(S, "near_duplicate_links", lambda *a, **b: searches.append(1) or links(*a, **b))
    clusters = K.message_clusters(messages)
    assert [K.consistency_report(messages, a, features, clusters=clusters)["summary"].first() for a in actions] == apart
    assert len(searches) == 1 and apart[0].divergent_pairs > 0
    reps, members = S._representatives(messages.selectExpr("message_id AS id", "message_text AS text"))
    assert not any("normalise" in df._jdf.queryExecution().toString() or "EvalPython" in df._jdf.queryExecution().toString() for df in (reps, members))
