"""Routing, validation, the safety gate and the failure policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake import config as C
from triagelake.catalog import sqltext as q
from triagelake.catalog.joins import BUSINESS, DND_SQL, DOSSIER_VIEWS, GROUPS, MEDIA, PAIRS, RELATION, tables
from triagelake.catalog.registry import Registry, joined, rounded
from triagelake.catalog.scalars import vocab_sql
from triagelake.functions.vocab import ordered_evidence
from triagelake.operators import failure, gate, validation
from triagelake.plans.dossier import build_dossier
from triagelake.plans.router import route, routing_features, sweep
from triagelake.plans.run import decide, with_decisions

REGISTRY = Registry()
add = REGISTRY.add

# --- Rule-only routing ------------------------------------------------------------------------
ROUTER_VIEWS = ("messages", "history", "message_events", "business_accounts", "user_business_history")
_FEATURES = q.ENGAGED + q.PEER_ENGAGEMENT + q.signals() + q.ACCOUNTS + BUSINESS


def rule_sql(verdict: str = "a.brand_verdict", dismiss: float = 0.5, least: int = 1) -> str:
    return f"""CASE WHEN s.injection_match IS NOT NULL THEN 'injection_match' WHEN s.credential_request IS NOT NULL THEN 'credential_request'
  WHEN {verdict} = 'impersonation' THEN 'brand_impersonation' WHEN b.opted_out AND s.is_promotional THEN 'promotion_opt_out'
  WHEN p.peer_dismiss_rate >= {dismiss} AND p.peer_n >= {least} THEN 'peer_dismiss_rate'
  WHEN s.has_mention OR s.has_deadline THEN 'attention_marker' ELSE 'default' END"""


_ROUTE_FROM = """ FROM sig s JOIN peer_eng p ON s.message_id = p.message_id LEFT JOIN biz b ON s.message_id = b.message_id
  LEFT JOIN acc a ON s.conversation_type = 'business' AND s.business_id = a.business_id"""
ACTION_OF = "CASE rule WHEN 'attention_marker' THEN 'notify' WHEN 'default' THEN 'digest' ELSE 'mute' END"
TYPE_OF = ("CASE WHEN rule IN ('injection_match', 'credential_request', 'brand_impersonation') THEN 'scam' "
           "WHEN rule = 'promotion_opt_out' THEN 'promotion' ELSE keyword_type END")
ROUTED = _FEATURES + f""", ruled AS (SELECT s.message_id, s.keyword_type, {rule_sql()} AS rule{_ROUTE_FROM}),
routed AS (SELECT message_id, {ACTION_OF} AS action, {TYPE_OF} AS message_type, rule FROM ruled)"""


@add("R08_rule_router", ROUTER_VIEWS, ROUTED + " SELECT * FROM routed")
def rule_router(load):
    return route(routing_features(tables(load)))


@add("W04_first_rule", ROUTER_VIEWS, ROUTED + " SELECT rule, action, count(*) AS n FROM routed GROUP BY ALL")
def first_rule(load):
    return route(routing_features(tables(load))).groupBy("rule", "action").agg(F.count("*").alias("n"))


def _sweep_sql() -> str:
    arms, names = [], {"brand_min_age_days": "age", "brand_max_reports": "reports"}
    for name, values in C.SWEEP_VALUES.items():
        for value in values:
            brand = q.verdict(**{names[name]: value}) if name in names else q.verdict()
            extra = {"dismiss": value} if name == "dismiss_mute_threshold" else {"least": value} if name == "min_peer_history" else {}
            arms.append(f"""SELECT '{name}' AS parameter, {float(value)}::DOUBLE AS value, r.* FROM (
  SELECT message_id, keyword_type, {rule_sql(brand, **extra)} AS rule FROM wide s, LATERAL (SELECT 1) x) r""")
    body = " UNION ALL ".join(arms).replace("a.brand_verdict", "brand_verdict").replace("s.injection", "injection").replace(
        "s.credential", "credential").replace("b.opted", "opted").replace("s.is_", "is_").replace("p.peer", "peer").replace("s.has", "has")
    return _FEATURES + f""", wide AS (SELECT s.message_id, s.keyword_type, s.injection_match, s.credential_request, s.is_promotional, s.has_mention, s.has_deadline,
  b.opted_out, p.peer_dismiss_rate, p.peer_n, a.mm, a.verified, a.account_age_days, a.domain_used_by_sender_age_days, a.user_reports_30d{_ROUTE_FROM}),
grid AS ({body}), scored AS (SELECT parameter, value, count(*) AS total, count_if({ACTION_OF} = g.action) AS action_correct,
  count_if({TYPE_OF} = g.message_type) AS type_correct, count_if({ACTION_OF} = g.action AND {TYPE_OF} = g.message_type) AS joint_correct
  FROM grid JOIN gold_messages g ON grid.message_id = g.message_id GROUP BY parameter, value)
SELECT *, action_correct = max(action_correct) OVER (PARTITION BY parameter) AS is_best FROM scored"""


@add("R09_threshold_sweep", (*ROUTER_VIEWS, "gold_messages"), _sweep_sql().replace(" s, LATERAL (SELECT 1) x", ""))
def threshold_sweep(load):
    return sweep(routing_features(tables(load)), load("gold_messages"))


# --- Validation ---------------------------------------------------------------------------------
_PARSED = f""", pj AS (SELECT message_id, payload AS j, json_extract_string(payload, '$.reason') AS reason0 FROM raw_decisions),
ps AS (SELECT message_id, j,
  CASE WHEN json_type(j, '$.action') = 'VARCHAR' THEN json_extract_string(j, '$.action') END AS raw_action,
  CASE WHEN json_type(j, '$.message_type') = 'VARCHAR' THEN json_extract_string(j, '$.message_type') END AS raw_type,
  CASE WHEN json_type(j, '$.reason') = 'VARCHAR' THEN reason0 END AS reason,
  CASE WHEN json_type(j, '$.confidence') <> 'BOOLEAN' AND TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1
    THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence,
  json_extract_string(j, '$.evidence_message_ids') AS ev, json_extract_string(j, '$.risk_axis') AS k, json_extract_string(j, '$.relevance_axis') AS l,
  json_extract_string(j, '$.urgency_axis') AS u,
  (SELECT count(*) FROM (VALUES ('action'), ('message_type'), ('reason'), ('confidence'), ('evidence_message_ids'), ('risk_axis'), ('relevance_axis'), ('urgency_axis')) v(f)
    WHERE json_type(j, concat('$.', v.f)) IS NULL) AS n_missing,
  json_type(j, '$.deadline_minutes') AS dt, json_extract_string(j, '$.deadline_minutes') AS dm, json_type(j, '$.material_harm') AS ht FROM pj),
pe AS (SELECT *, CASE WHEN ev = 'none' THEN []::VARCHAR[] WHEN list_contains(string_split(ev, ';'), '') OR contains(ev, ' ')
   OR list_contains(string_split(ev, ';'), 'none') THEN NULL ELSE string_split(ev, ';') END AS cited,
  {vocab_sql('raw_action', C.ACTIONS)} AS va, {vocab_sql('raw_type', C.MESSAGE_TYPES)} AS vt FROM ps),
sc AS (SELECT *, CASE WHEN n_missing > 0 THEN rtrim(repeat('missing_field,', n_missing), ',') ELSE concat_ws(',', CASE WHEN reason IS NULL THEN 'invalid_reason' END,
  CASE WHEN confidence IS NULL THEN 'invalid_confidence' END, CASE WHEN cited IS NULL THEN 'invalid_evidence_format' END,
  CASE WHEN k NOT IN ('clean', 'suspect', 'suspicious', 'unsafe', 'scam_or_unsafe') THEN 'invalid_risk_axis' END,
  CASE WHEN l NOT IN ('high', 'wanted', 'relevant', 'medium', 'neutral', 'low', 'unwanted') THEN 'invalid_relevance_axis' END,
  CASE WHEN u NOT IN ('immediate', 'today', 'none') THEN 'invalid_urgency_axis' END,
  CASE WHEN dt IS NOT NULL AND (dt = 'VARCHAR' OR TRY_CAST(dm AS INT) < 0) THEN 'invalid_deadline_minutes' END,
  CASE WHEN ht <> 'BOOLEAN' THEN 'invalid_material_harm' END) END AS schema_codes,
  split_part(va, '|', 1) AS action, split_part(vt, '|', 1) AS mtype, split_part(va, '|', 2) AS ta, split_part(vt, '|', 2) AS tt FROM pe),
co AS (SELECT *, concat_ws(',', CASE WHEN ta IN ('invalid', 'ambiguous') THEN concat(ta, '_action') END,
  CASE WHEN tt IN ('invalid', 'ambiguous') THEN concat(tt, '_message_type') END) AS coercion_codes,
  CASE WHEN schema_codes <> '' THEN 0 ELSE (ta IN ('normalised', 'token_subset'))::INT + (tt IN ('normalised', 'token_subset'))::INT END AS coercion_count FROM sc)"""
_VALIDATED = PAIRS + _PARSED + f""",
offered AS (SELECT message_id, list(history_message_id) AS ids, list(CASE WHEN dismissed OR muted_after OR reported THEN history_message_id END) AS negative FROM evd GROUP BY 1),
iv AS (SELECT c.*, coalesce(o.ids, []::VARCHAR[]) AS ids, list_filter(c.cited, lambda x: list_contains(coalesce(o.ids, []::VARCHAR[]), x)) AS kept,
  list_filter(c.cited, lambda x: NOT list_contains(coalesce(o.ids, []::VARCHAR[]), x)) AS dropped,
  list_has_any(list_filter(c.cited, lambda x: list_contains(coalesce(o.ids, []::VARCHAR[]), x)), coalesce(o.negative, []::VARCHAR[])) AS has_negative
  FROM co c LEFT JOIN offered o ON c.message_id = o.message_id),
ic AS (SELECT *, concat_ws(',', CASE WHEN k IN ('unsafe', 'scam_or_unsafe') AND (action <> 'mute' OR mtype NOT IN ('scam', 'spam')) THEN 'I1' END,
  CASE WHEN action = 'notify' AND u = 'none' THEN 'I2' END,
  CASE WHEN l IN ('low', 'unwanted') AND action = 'mute' AND k = 'clean' AND NOT has_negative THEN 'I3' END,
  CASE WHEN len(kept) = 0 AND len(ids) > 0 THEN 'I5' END, CASE WHEN len(kept) > 2 THEN 'I6' END) AS invariant_codes,
  {q.style_codes('reason')} AS style_codes FROM iv),
vd AS (SELECT *, CASE WHEN schema_codes <> '' THEN 'schema' WHEN coercion_codes <> '' THEN 'coercion' WHEN invariant_codes <> '' THEN 'invariants'
  WHEN style_codes <> '' THEN 'reason_style' END AS stage FROM ic)"""
_VALIDATION_VIEWS = (*q.ENGAGED_VIEWS, "raw_decisions")


@add("V01_schema_stage", ("raw_decisions",), _PARSED + " SELECT message_id, schema_codes AS codes FROM sc")
def schema_stage(load):
    return validation.parse_decisions(load("raw_decisions")).select("message_id", joined("schema_codes").alias("codes"))


@add("V02_coercion_stage", ("raw_decisions",), _PARSED + """ SELECT message_id, nullif(action, '') AS action, nullif(mtype, '') AS message_type,
  CASE WHEN schema_codes <> '' THEN '' ELSE coercion_codes END AS codes, coercion_count FROM co""")
def coercion_stage(load):
    out = validation.coerce_labels(validation.parse_decisions(load("raw_decisions")))
    return out.select("message_id", "action", "message_type", joined("coercion_codes").alias("codes"), "coercion_count")


def _context(load):
    from triagelake.catalog.joins import _ranked
    from triagelake.operators.context import media_context
    rows = load("messages").select("message_id", "media_type", "media_id")
    return (rows.join(_ranked(load).select("message_id", "evidence"), "message_id")
            .join(media_context(load("messages"), load("media")).select("message_id", "file_exists"), "message_id", "left")
            .withColumn("file_exists", F.coalesce("file_exists", F.lit(False))))


def _validated(load):
    return validation.validate_decisions(load("raw_decisions"), _context(load))


@add("J12_offered_citations", _VALIDATION_VIEWS, _VALIDATED + """ SELECT message_id, array_to_string(kept, ',') AS kept, array_to_string(dropped, ',') AS dropped
  FROM iv WHERE cited IS NOT NULL""")
def offered_citations(load):
    parsed = validation.coerce_labels(validation.parse_decisions(load("raw_decisions"))).join(_context(load), "message_id")
    out = validation.check_invariants(parsed.withColumn("inspected_media_ids", F.lit(None).cast("array<string>"))).filter("cited IS NOT NULL")
    return out.select("message_id", joined("evidence_ids").alias("kept"), joined("dropped_ids").alias("dropped"))


@add("V03_invariants", _VALIDATION_VIEWS, _VALIDATED + " SELECT message_id, invariant_codes AS codes FROM vd WHERE stage IS NULL OR stage IN ('invariants', 'reason_style')")
def invariants(load):
    out = _validated(load).filter("stage IS NULL OR stage IN ('invariants', 'reason_style')")
    return out.select("message_id", F.when(F.col("stage") == "invariants", joined("codes")).otherwise("").alias("codes"))


@add("V04_style_stage", _VALIDATION_VIEWS, _VALIDATED + """ SELECT message_id, style_codes AS codes,
  style_codes IN ('reason_length', 'reason_sentence_count', 'reason_length,reason_sentence_count') AS repairable FROM vd WHERE stage = 'reason_style'""")
def style_stage(load):
    return _validated(load).filter("stage = 'reason_style'").select("message_id", joined("codes").alias("codes"), "repairable")


@add("V05_validation_result", _VALIDATION_VIEWS, _VALIDATED + """ SELECT message_id, stage, CASE stage WHEN 'schema' THEN schema_codes WHEN 'coercion' THEN coercion_codes
  WHEN 'invariants' THEN invariant_codes WHEN 'reason_style' THEN style_codes ELSE '' END AS codes, coercion_count,
  CASE WHEN stage IS NULL OR stage IN ('invariants', 'reason_style') THEN array_to_string(dropped, ',') ELSE '' END AS dropped FROM vd""")
def validation_result(load):
    return _validated(load).select("message_id", "stage", joined("codes").alias("codes"), "coercion_count", joined("dropped_ids").alias("dropped"))


_OPENED = "CASE WHEN m.media_type = 'image' AND m.forwarded_count % 3 <> 1 THEN 1 ELSE 0 END"


@add("V03_inspection", (*_VALIDATION_VIEWS, "media"), _VALIDATED + f""",
seen AS (SELECT ic.*, m.media_type = 'image' AND m.media_id IS NOT NULL AND coalesce(d.file_exists, false) AS readable, {_OPENED} = 1 AS opened,
  coalesce(json_type(ic.j, '$.media_observation'), 'NULL') <> 'NULL' AS observed
  FROM ic JOIN messages m ON ic.message_id = m.message_id LEFT JOIN media d ON d.kind = m.media_type AND d.media_id = m.media_id)
SELECT message_id, concat_ws(',', CASE WHEN readable AND NOT opened THEN 'I7' END, CASE WHEN readable AND opened AND NOT observed THEN 'I8' END,
  nullif(invariant_codes, '')) AS codes FROM seen
WHERE schema_codes = '' AND coercion_codes = '' AND (invariant_codes <> '' OR (readable AND NOT (opened AND observed)))""")
def inspection(load):
    """Image rules: some attachments were never opened, some opened ones have no observation."""
    opened = load("messages").select("message_id", F.when(
        (F.col("media_type") == "image") & (F.col("forwarded_count") % 3 != 1), F.array("media_id")).alias("_opened"))
    context = _context(load).join(opened, "message_id").withColumn(
        "inspected_media_ids", F.coalesce("_opened", F.array().cast("array<string>"))).drop("_opened")
    out = validation.validate_decisions(load("raw_decisions"), context)
    return out.filter("stage = 'invariants'").select("message_id", joined("codes").alias("codes"))


# --- The safety gate ------------------------------------------------------------------------------
GATE_VIEWS = (*DOSSIER_VIEWS, "decisions")
_ACC = q.ACCOUNTS
_FACTS = (RELATION + PAIRS[len(q.ENGAGED):] + q.signals().replace(",\ntxt AS", ",\nctxt AS").replace("FROM txt)", "FROM ctxt)")
          + _ACC + GROUPS + BUSINESS + DND_SQL + q.DETECTED + f""",
facts AS (SELECT d.message_id, d.action AS a0, d.message_type AS t0, d.reason AS r0, d.confidence AS c0, d.risk, d.urgency, d.deadline_minutes, d.material_harm,
  d.media_mismatch_reason AS why, d.media_mismatch AND s.media_type IS NOT NULL AS mismatch, coalesce(s.injection_match, det.attack_phrase) AS inj,
  det.credential_phrase AS cred, det.payment_phrase AS pay, a.brand_verdict AS bv, a.brand_name, a.user_reports_30d AS reports,
  coalesce(grp.sender_role IN ('admin', 'owner'), false) AS is_admin, peer_n AS n, peer_dismiss_rate AS dr, peer_report_rate AS rr,
  peer_n = 0 AND global_n = 0 AND NOT EXISTS (SELECT 1 FROM evd WHERE evd.message_id = d.message_id) AS bare, biz.promotions_opted_out_at AS opted_at,
  dnd.do_not_disturb_window AS dw, dnd.in_dnd, CASE WHEN in_dnd THEN (dnd_end - mn + 1440) % 1440 END AS left_min
  FROM decisions d JOIN sig s ON d.message_id = s.message_id JOIN det ON d.message_id = det.message_id
  LEFT JOIN acc a ON s.conversation_type = 'business' AND s.business_id = a.business_id JOIN peer_eng ON d.message_id = peer_eng.message_id
  JOIN global_eng ON d.message_id = global_eng.message_id LEFT JOIN grp ON d.message_id = grp.message_id LEFT JOIN biz ON d.message_id = biz.message_id
  JOIN dnd ON d.message_id = dnd.message_id)""")
_BRAND_CLAUSE = "CASE WHEN bv <> 'clean' THEN concat('a ', bv, ' brand-integrity verdict') END"


def _quote(x: str) -> str:
    return q.cut(f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))", 44)


_GATED = _FACTS + f""",
ctx AS (SELECT *, concat_ws(', ', {_BRAND_CLAUSE}, CASE WHEN rr > 0 THEN concat('a ', {q.percent('rr')}, ' report rate with this user') END,
  CASE WHEN n = 0 THEN 'no prior contact with this user' END, CASE WHEN NOT is_admin THEN 'no admin standing in this channel' END) AS untrusted,
  concat_ws(', ', CASE WHEN pay IS NOT NULL THEN 'a payment demand' END, CASE WHEN cred IS NOT NULL THEN 'a credential request' END, {_BRAND_CLAUSE}) AS esc FROM facts),
fired AS (SELECT *, inj IS NOT NULL AS f1, cred IS NOT NULL AS f2, coalesce(bv = 'impersonation', false) AS f3, pay IS NOT NULL AND untrusted <> '' AS f4,
  opted_at IS NOT NULL AND t0 = 'promotion' AS f5, coalesce(dr >= 0.5 AND n >= 1 AND risk = 'clean' AND urgency <> 'immediate' AND NOT is_admin, false) AS f6,
  mismatch AS f7 FROM ctx),
g1 AS (SELECT *, f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR (f7 AND esc <> '') AS blocked FROM fired),
g2 AS (SELECT *, CASE WHEN blocked THEN 'mute' ELSE a0 END AS safe_action FROM g1),
g3 AS (SELECT *, safe_action = 'notify' AND in_dnd AND NOT material_harm AND NOT coalesce(deadline_minutes < left_min, false) AS f8 FROM g2),
g4 AS (SELECT *, CASE WHEN f8 THEN 'digest' ELSE safe_action END AS action,
  CASE WHEN t0 = 'scam' OR f1 OR f2 OR f3 OR f4 THEN 'scam' WHEN f7 AND esc <> '' THEN 'scam' WHEN f5 THEN 'promotion' ELSE t0 END AS message_type,
  concat_ws(',', CASE WHEN f1 THEN 'INJECTION' END, CASE WHEN f2 THEN 'CREDENTIAL_REQUEST' END, CASE WHEN f3 THEN 'BRAND_IMPERSONATION' END,
    CASE WHEN f4 THEN 'PAYMENT_PRESSURE_UNTRUSTED' END, CASE WHEN f5 THEN 'OPT_OUT' END, CASE WHEN f6 THEN 'BEHAVIOURAL_DEMOTION' END,
    CASE WHEN f7 THEN 'MEDIA_MISMATCH' END, CASE WHEN f8 THEN 'DND_INTERRUPTION_COST' END) AS rules,
  {q.clamp("CASE WHEN blocked THEN least(c0 - CASE WHEN mismatch THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN bare THEN 0.05::DOUBLE ELSE 0 END, 0.85::DOUBLE) ELSE c0 - CASE WHEN mismatch THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN bare THEN 0.05::DOUBLE ELSE 0 END END")} AS confidence,
  CASE WHEN f1 THEN concat('The message text tries to dictate its own delivery with "', {_quote('inj')}, '", which is recorded as evidence rather than followed.')
    WHEN f2 THEN concat('The message asks the user to hand over a credential with "', {_quote('cred')}, '", which no legitimate sender does.')
    WHEN f3 THEN concat('The sender fails all five brand-integrity checks for ', brand_name, ', including a mismatched sender domain and ', {q.plural('reports', 'user report')}, ' against 29 tolerated.')
    WHEN f4 THEN concat('The message demands payment with "', {_quote('pay')}, '" from a sender with ', untrusted, '.')
    WHEN f5 THEN concat('The user opted out of promotions from this business on ', strftime(opted_at, '%Y-%m-%d'), ' and this message is promotional.')
    WHEN f6 THEN concat('This user dismisses ', {q.percent('dr')}, ' of the ', {q.plural('n', 'previous message')}, ' from this sender.')
    WHEN f7 AND esc <> '' THEN concat('The attachment does not support the message text and arrives alongside ', esc, '.')
    WHEN f8 THEN concat('The message arrived inside the user''s ', dw, ' do-not-disturb window and carries no deadline that closes before the window ends.') END AS sentence FROM g3),
gated AS (SELECT *, CASE WHEN sentence IS NULL THEN trim(r0) WHEN action <> a0 THEN sentence
  WHEN {q.restates('sentence', 'r0')} OR {q.style_codes('sentence')} <> '' THEN trim(r0) ELSE sentence END AS reason FROM g4)"""


def _gate_input(load):
    dossier = build_dossier(tables(load), medians=False)
    decisions = load("decisions").withColumn("evidence_ids", ordered_evidence(F.col("evidence_message_ids"))).drop("evidence_message_ids")
    return gate.detect(dossier).join(decisions, "message_id")


@add("R05_gate_facts", GATE_VIEWS, _FACTS + """ SELECT message_id, inj AS injection_phrase, cred AS credential_phrase, pay AS payment_phrase, is_admin AS sender_is_admin,
  n = 0 AS first_contact, bare AS first_contact_without_evidence, mismatch, coalesce(bv <> 'clean', false) AS unclean_brand FROM facts""")
def gate_facts(load):
    return gate.gate_facts(_gate_input(load)).select(
        "message_id", "injection_phrase", "credential_phrase", "payment_phrase", "sender_is_admin", "first_contact",
        "first_contact_without_evidence", "mismatch", "unclean_brand")


@add("R06_safety_gate", GATE_VIEWS, _GATED + """ SELECT message_id, action, message_type, confidence, rules, action <> a0 AS action_changed, blocked AS hard_blocked FROM gated""")
def safety_gate(load):
    final = gate.assert_one_directional(gate.apply_gate(_gate_input(load)))
    return final.select("message_id", "action", "message_type", "confidence", joined("rules_fired").alias("rules"),
                        F.col("gate_trace._gate_action_changed").alias("action_changed"), F.col("gate_trace._gate_hard_blocked").alias("hard_blocked"))


@add("R07_gate_reason", GATE_VIEWS, _GATED + " SELECT message_id, reason FROM gated")
def gate_reason(load):
    return gate.apply_gate(_gate_input(load)).select("message_id", "reason")


@add("R14_one_directional", GATE_VIEWS, _GATED + f""" SELECT message_id, action FROM gated WHERE {q.severity('action')} < {q.severity('a0')}
  OR confidence > {q.clamp('c0')} + 1e-9""")
def one_directional(load):
    """Violations of the gate's invariant: always empty."""
    return gate.gate_violations(gate.apply_gate(_gate_input(load))).select("message_id", "action")


# --- Failure policy ---------------------------------------------------------------------------------
_FALLBACK_TYPE = """CASE WHEN s.credential_request IS NOT NULL OR s.injection_match IS NOT NULL THEN 'scam' WHEN a.brand_verdict = 'impersonation' THEN 'scam'
  WHEN s.payment_pressure IS NOT NULL THEN 'payment' WHEN s.forwarded_count > 0 THEN 'forward' WHEN s.conversation_type = 'business' THEN 'business_update'
  WHEN s.conversation_type = 'personal' THEN 'personal' ELSE 'unknown' END"""
_CLAUSE = f"""CASE WHEN stage IN ('schema', 'coercion') THEN {q.quoted(failure.BAD_SHAPE)} WHEN stage = 'invariants' THEN {q.quoted(failure.BAD_INVARIANT)}
  WHEN stage = 'reason_style' THEN {q.quoted(failure.BAD_STYLE)} ELSE {q.quoted(failure.NO_DECISION)} END"""
_SIGNALS = q.signals().replace(",\ntxt AS", ",\nctxt AS").replace("FROM txt)", "FROM ctxt)")
_ST = f""",
fb AS (SELECT s.message_id, vd.stage, vd.style_codes, {_FALLBACK_TYPE} AS ftype, concat(CASE s.conversation_type
    WHEN 'business' THEN CASE WHEN a.brand_name IS NOT NULL THEN concat('A business notice from ', a.brand_name) ELSE 'A business notice' END
    WHEN 'group' THEN CASE WHEN grp.group_name IS NOT NULL THEN concat('A group message in ', grp.group_name) ELSE 'A group message' END
    ELSE 'A personal message' END, CASE s.media_type WHEN 'voice' THEN ' with a voice note' WHEN 'image' THEN ' with an image attachment' ELSE '' END, {_CLAUSE}) AS described,
  (SELECT min(history_message_id) FROM evd WHERE evd.message_id = s.message_id AND evd.rank = 1) AS top_id, vd.action AS va_action, vd.mtype AS v_type
  FROM sig s JOIN vd ON s.message_id = vd.message_id LEFT JOIN acc a ON s.conversation_type = 'business' AND s.business_id = a.business_id
  LEFT JOIN grp ON s.message_id = grp.message_id),
st AS (SELECT *, CASE WHEN stage IS NULL THEN 'submitted' WHEN stage = 'reason_style' AND style_codes IN ('reason_length', 'reason_sentence_count',
  'reason_length,reason_sentence_count') THEN 'reason_repaired' ELSE 'validation_rejected' END AS outcome FROM fb)"""
_SETTLED = _VALIDATED + _SIGNALS + _ACC + GROUPS + _ST
_SETTLE_VIEWS = (*DOSSIER_VIEWS, "raw_decisions")


def _settled(load):
    row = with_decisions(build_dossier(tables(load), medians=False), load("raw_decisions"))
    return failure.settle(validation.judge(row))


@add("R10_fallback_decision", _SETTLE_VIEWS, _SETTLED + f""" SELECT message_id, ftype AS message_type, CASE WHEN {q.style_codes('described')} = '' THEN described
  ELSE {q.quoted(failure.GENERIC_REASON)} END AS reason, coalesce(top_id, '') AS evidence FROM st WHERE outcome = 'validation_rejected'""")
def fallback(load):
    return _settled(load).filter("outcome = 'validation_rejected'").select("message_id", "message_type", "reason", joined("evidence_ids").alias("evidence"))


@add("R11_failure_policy", _SETTLE_VIEWS, _SETTLED + """ SELECT message_id, outcome, CASE WHEN outcome = 'validation_rejected' THEN 'digest' ELSE va_action END AS action,
  CASE WHEN outcome = 'validation_rejected' THEN ftype ELSE v_type END AS message_type FROM st""")
def failure_policy(load):
    return _settled(load).select("message_id", "outcome", "action", "message_type")


_SEEN = "(p.peer_open_rate IS NOT NULL AND p.peer_n > 0)"
_OPENS = q.percent("p.peer_open_rate")
_BEFORE = q.plural("p.peer_n", "previous message")
_BRAND = "CASE WHEN length(a.brand_name) > 0 THEN a.brand_name ELSE 'this business' END"


def _unquoted(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\"“”]', '', 'g'))"


def _repaired(given: str) -> str:
    """First true sentence that keeps the contract, for (message_id, action, message_type, deadline_minutes) of ``given``."""
    adverse = f"""[CASE WHEN x.cred IS NOT NULL THEN concat('A request for a credential worded "', {_unquoted('x.cred')}, '" decided this message ahead of any standing the sender has.') END,
  CASE WHEN x.inj IS NOT NULL THEN concat('Text trying to dictate its own delivery with "', {_unquoted('x.inj')}, '" was recorded as evidence against this sender.') END,
  CASE WHEN x.pay IS NOT NULL THEN concat('A demand for payment worded "', {_unquoted('x.pay')}, '" decided this message against the sender''s history.') END,
  CASE WHEN a.brand_verdict = 'impersonation' THEN concat('A sender domain that does not match the official ', {_BRAND}, ' domain, with ', {q.plural('a.user_reports_30d', 'user report')}, ', decided this notice.') END,
  CASE WHEN b.opted_out AND d.message_type = 'promotion' THEN 'A promotion from a business whose promotions this user has already opted out of decided this message.' END,
  CASE WHEN p.peer_dismiss_rate >= 0.5 AND p.peer_n > 0 THEN concat('This recipient dismissed ', {q.percent('p.peer_dismiss_rate')}, ' of the ', {_BEFORE}, ' from this sender.') END,
  CASE WHEN f.n > 0 THEN concat('This message repeats ', {q.plural('f.n', 'earlier message')}, ' from the same sender in the retained history.') END,
  CASE WHEN s.forwarded_count > 0 THEN concat('This message arrived as a forward with a hop count of ', s.forwarded_count, ', which decided it against the sender''s history.') END]"""
    supporting = f"""[CASE WHEN d.deadline_minutes IS NOT NULL AND {_SEEN} THEN concat('The message states a deadline and this recipient opens ', {_OPENS}, ' of the ', {_BEFORE}, ' from this sender.') END,
  CASE WHEN g.sender_role = 'admin' THEN concat('A group admin in ', g.group_name, ' sent this notice', CASE WHEN {_SEEN} THEN concat(' and this recipient opens ', {_OPENS}, ' of them') ELSE '' END, '.') END,
  CASE WHEN length(b.why_user_knows_account) > 0 THEN concat('A business notice matching this recipient''s ', trim(replace(b.why_user_knows_account, '_', ' ')),
    ' decided this message, from an account', CASE WHEN {_SEEN} THEN concat(' opened ', {_OPENS}, ' of the time') ELSE '' END, '.') END,
  CASE WHEN {_SEEN} THEN concat('This recipient opens ', {_OPENS}, ' of the ', {_BEFORE}, ' from this sender.') END]"""
    return f""",
figures AS (SELECT message_id, count_if(jac >= 0.45) AS n FROM prs GROUP BY 1),
rtx AS (SELECT message_id, {q.guard('w')} AS g FROM ctxt),
phr AS (SELECT message_id, {q.attack('g')} AS inj, {q.credential('g')} AS cred, {q.payment('g')} AS pay FROM rtx),
options AS (SELECT d.message_id, CASE WHEN d.action = 'notify' AND x.inj IS NULL AND x.cred IS NULL AND x.pay IS NULL
  THEN list_concat({supporting}, {adverse}) ELSE list_concat({adverse}, {supporting}) END AS sentences
  FROM {given} d JOIN sig s ON d.message_id = s.message_id JOIN phr x ON d.message_id = x.message_id JOIN peer_eng p ON d.message_id = p.message_id
  LEFT JOIN acc a ON s.conversation_type = 'business' AND s.business_id = a.business_id LEFT JOIN grp g ON d.message_id = g.message_id
  LEFT JOIN biz b ON d.message_id = b.message_id LEFT JOIN figures f ON d.message_id = f.message_id),
offers AS (SELECT message_id, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS i FROM options),
repaired AS (SELECT o.message_id, coalesce(arg_min(sentence, i) FILTER (WHERE sentence IS NOT NULL AND {q.style_codes('sentence')} = ''),
  {q.quoted(failure.FLOOR_SENTENCE)}) AS reason FROM offers o GROUP BY 1)"""


@add("R12_reason_repair", GATE_VIEWS, RELATION + PAIRS[len(q.ENGAGED):] + _SIGNALS + _ACC + GROUPS + BUSINESS + _repaired("decisions") + " SELECT message_id, reason FROM repaired")
def reason_repair(load):
    """Repaired sentence of every message under its supplied action and type."""
    dossier = failure.with_repair_phrases(build_dossier(tables(load), medians=False))
    given = load("decisions").select("message_id", "action", "message_type", "deadline_minutes")
    return dossier.join(given, "message_id").select("message_id", failure.repair_reason().alias("reason"))


_RISK = "CASE v.k " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in C.RISK_AXES.items()) + " END"
RUN_SQL = (RELATION + PAIRS[len(q.ENGAGED):] + _VALIDATED[len(PAIRS):] + _SIGNALS + _ACC + GROUPS + BUSINESS + DND_SQL + q.DETECTED + _ST + """,
given AS (SELECT st.message_id, va_action AS action, v_type AS message_type, CASE WHEN v.dt IN ('UBIGINT', 'BIGINT') THEN CAST(v.dm AS BIGINT) END AS deadline_minutes
  FROM st JOIN vd v ON st.message_id = v.message_id WHERE outcome = 'reason_repaired')""" + _repaired("given") + f""",
settled AS (SELECT st.message_id, outcome, CASE WHEN keeps THEN va_action ELSE 'digest' END AS action, CASE WHEN keeps THEN v_type ELSE ftype END AS message_type,
  CASE outcome WHEN 'submitted' THEN v.reason WHEN 'reason_repaired' THEN r.reason ELSE CASE WHEN {q.style_codes('described')} = '' THEN described
    ELSE {q.quoted(failure.GENERIC_REASON)} END END AS reason,
  CASE WHEN keeps THEN v.confidence ELSE {C.CONF_FLOOR}::DOUBLE END AS confidence,
  CASE WHEN keeps THEN array_to_string(v.kept, ',') ELSE coalesce(top_id, '') END AS evidence,
  CASE WHEN keeps THEN {_RISK} ELSE 'clean' END AS risk, CASE WHEN keeps THEN v.u ELSE 'none' END AS urgency,
  CASE WHEN keeps AND v.dt IN ('UBIGINT', 'BIGINT') THEN CAST(v.dm AS BIGINT) END AS deadline_minutes,
  keeps AND coalesce(json_extract_string(v.j, '$.material_harm') = 'true', false) AS material_harm,
  keeps AND coalesce(json_extract_string(v.j, '$.media_observation.corroborates_message_claim') IN ('no', 'partial'), false) AS media_mismatch,
  CASE WHEN keeps THEN json_extract_string(v.j, '$.media_observation.mismatch_reason') END AS media_mismatch_reason
  FROM (SELECT *, outcome IN ('submitted', 'reason_repaired') AS keeps FROM st) st JOIN vd v ON st.message_id = v.message_id
  LEFT JOIN repaired r ON st.message_id = r.message_id)""" + _FACTS[_FACTS.index(",\nfacts AS"):].replace("FROM decisions d", "FROM settled d") + _GATED[len(_FACTS):] + """
SELECT g.message_id, g.action, g.message_type, g.reason, g.confidence, t.evidence, g.rules, t.outcome FROM gated g JOIN settled t ON g.message_id = t.message_id""")


@add("R17_full_run", (*DOSSIER_VIEWS, "raw_decisions"), RUN_SQL)
def full_run(load):
    """Features, supplied decisions, failure policy and gate in one job."""
    final = decide(tables(load), load("raw_decisions"))
    return final.select("message_id", "action", "message_type", "reason", "confidence", joined("evidence_ids").alias("evidence"),
                        joined("rules_fired").alias("rules"), "outcome")
