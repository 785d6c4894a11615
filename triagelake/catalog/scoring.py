"""Evaluation against labels, reason scores and audits of finished runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake import config as C
from triagelake.catalog import sqltext as q
from triagelake.catalog.joins import PAIRS, tables
from triagelake.catalog.outcomes import ROUTED, ROUTER_VIEWS
from triagelake.catalog.registry import Registry, joined, rounded
from triagelake.operators import audit, evaluation as E
from triagelake.plans.evaluate import evaluate, output_verdict
from triagelake.plans.router import route, routing_features
from triagelake.sources import contracts

REGISTRY = Registry()
add = REGISTRY.add

_VIEWS = ("gold_samples", "prediction_samples")
PAIRED = """, gs AS (SELECT message_id, action AS ga, message_type AS gt, confidence AS gc, CASE WHEN evidence_message_ids = 'none' THEN []::VARCHAR[]
  ELSE list_distinct(string_split(evidence_message_ids, ';')) END AS gi FROM gold_samples),
psm AS (SELECT message_id, action AS pa, message_type AS pt, confidence AS pc, CASE WHEN evidence_message_ids = 'none' THEN []::VARCHAR[]
  ELSE list_distinct(string_split(evidence_message_ids, ';')) END AS pi, CASE WHEN evidence_message_ids = 'none' THEN []::VARCHAR[]
  ELSE string_split(evidence_message_ids, ';') END AS po FROM prediction_samples),
pr AS (SELECT gs.*, psm.* EXCLUDE (message_id), psm.message_id IS NOT NULL AS has FROM gs LEFT JOIN psm ON gs.message_id = psm.message_id)"""
METRICS = PAIRED + """, raw AS (SELECT count(*) AS total, count_if(coalesce(ga = pa, false)) AS action_correct, count_if(coalesce(gt = pt, false)) AS type_correct,
  count_if(coalesce(ga = pa AND gt = pt, false)) AS joint_correct, count_if(coalesce(ga = 'mute' AND pa = 'notify', false)) AS mute_to_notify,
  count_if(coalesce(ga = 'mute' AND pa = 'notify' AND gt = 'scam', false)) AS scam_to_notify, count_if(coalesce(ga = 'notify' AND pa = 'mute', false)) AS notify_to_mute,
  CAST(sum(CASE WHEN has THEN len(list_intersect(gi, pi)) ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN has THEN len(pi) - len(list_intersect(gi, pi)) ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN has THEN len(gi) - len(list_intersect(gi, pi)) ELSE len(gi) END) AS BIGINT) AS fn,
  avg(coalesce(abs(pc - gc), 1.0)) AS calibration_error, count_if(NOT has) AS missing_predictions FROM pr),
met AS (SELECT *, action_correct::DOUBLE / total AS action_accuracy, type_correct::DOUBLE / total AS type_accuracy, joint_correct::DOUBLE / total AS joint_accuracy,
  tp::DOUBLE / (tp + fp) AS evidence_precision, tp::DOUBLE / (tp + fn) AS evidence_recall, 2.0 * tp / (2 * tp + fp + fn) AS evidence_f1 FROM raw)"""


def _pairs(load):
    return E.pair_with_gold(load("gold_samples"), load("prediction_samples"))


def _metric_query(name: str, columns: tuple[str, ...]):
    shown = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" if c.startswith(("action_a", "type_a", "joint_a", "evidence", "calib")) else c for c in columns)

    @add(name, _VIEWS, METRICS + f" SELECT {shown} FROM met")
    def run(load):
        return rounded(E.metrics(_pairs(load)).select(*columns))


_metric_query("A07_accuracy", ("total", "action_correct", "type_correct", "joint_correct", "action_accuracy", "type_accuracy", "joint_accuracy"))
_metric_query("A09_dangerous_cells", ("mute_to_notify", "scam_to_notify", "notify_to_mute"))
_metric_query("A10_evidence_scores", ("tp", "fp", "fn", "evidence_precision", "evidence_recall", "evidence_f1"))
_metric_query("A11_confidence_error", ("calibration_error", "missing_predictions"))


@add("J13_gold_with_predictions", _VIEWS, PAIRED + " SELECT message_id, ga AS gold_action, pa AS pred_action, has AS predicted, coalesce(ga = pa, false) AS action_ok FROM pr")
def gold_with_predictions(load):
    return _pairs(load).select("message_id", "gold_action", "pred_action", "predicted", "action_ok")


@add("X02_evidence_sets", _VIEWS, PAIRED + """ SELECT message_id, array_to_string(list_sort(list_intersect(gi, pi)), ',') AS shared,
  array_to_string(list_sort([x for x in pi if NOT list_contains(gi, x)]), ',') AS only_predicted FROM pr WHERE has""")
def evidence_sets(load):
    return _pairs(load).filter("predicted").select("message_id", joined(F.array_sort(F.array_intersect("gold_ids", "pred_ids"))).alias("shared"),
                                                   joined(F.array_sort(F.array_except("pred_ids", "gold_ids"))).alias("only_predicted"))


def _vocab(words) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


for _kind, _g, _p, _words in (("action", "ga", "pa", C.ACTIONS), ("type", "gt", "pt", C.MESSAGE_TYPES)):
    def _confusion(load, kind=_kind):
        return E.confusion(_pairs(load), kind)

    def _drift(load, kind=_kind):
        return rounded(E.prior_drift(_pairs(load), kind))

    add(f"A08_confusion_{_kind}", _VIEWS, PAIRED + f""" SELECT g.w AS gold, p.w AS predicted, count(pr.message_id) AS n FROM {_vocab(_words)} g(w), {_vocab(_words)} p(w)
  LEFT JOIN pr ON pr.has AND pr.{_g} = g.w AND pr.{_p} = p.w GROUP BY ALL""")(_confusion)
    add(f"A13_prior_drift_{_kind}", _VIEWS, PAIRED + f""" SELECT w AS label, round(100.0 * (SELECT count(*) FROM pr WHERE {_g} = w) / (SELECT count(*) FROM pr), 6)::DOUBLE AS gold_pct,
  round(100.0 * (SELECT count(*) FROM pr WHERE {_p} = w) / (SELECT count(*) FROM pr), 6)::DOUBLE AS predicted_pct,
  round(100.0 * ((SELECT count(*) FROM pr WHERE {_p} = w) - (SELECT count(*) FROM pr WHERE {_g} = w)) / (SELECT count(*) FROM pr), 6)::DOUBLE AS delta_pp FROM {_vocab(_words)} v(w)""")(_drift)


@add("A12_reliability", _VIEWS, PAIRED + """ SELECT CAST(i AS INT) AS bin, count(pr.message_id) AS n, round(avg(pc), 9) AS mean_predicted, round(avg(gc), 9) AS mean_gold,
  round(avg(abs(pc - gc)), 9) AS mae, round(avg(coalesce(ga = pa, false)::INT) FILTER (pr.message_id IS NOT NULL), 9) AS action_accuracy,
  round(i / 20.0, 6)::DOUBLE AS lower, round((i + 1) / 20.0, 6)::DOUBLE AS upper
  FROM range(20) r(i) LEFT JOIN pr ON pr.has AND least(CAST(floor((pc + 1e-12::DOUBLE) * 20) AS INT), 19) = i GROUP BY i""")
def reliability(load):
    return rounded(E.reliability(_pairs(load)), 9)


@add("A14_composite", _VIEWS, METRICS + """ SELECT round(0.35 * action_accuracy + 0.25 * type_accuracy + 0.15 * evidence_f1 + 0.10 * (1.0 - calibration_error), 6)::DOUBLE AS composite FROM met""")
def composite(load):
    return rounded(E.composite_score(E.metrics(_pairs(load))))


@add("A15_slot_precision", _VIEWS, PAIRED + """, cited AS (SELECT gi, unnest(po) AS c, generate_subscripts(po, 1) AS slot FROM pr WHERE has)
SELECT CAST(slot AS INT) AS slot, count(*) AS attempts, count_if(list_contains(gi, c)) AS hits, round(count_if(list_contains(gi, c))::DOUBLE / count(*), 6) AS precision FROM cited GROUP BY slot""")
def slots(load):
    return rounded(E.slot_precision(_pairs(load)))


@add("A15_citation_counts", _VIEWS, PAIRED + """ SELECT 'gold' AS side, CAST(len(gi) AS INT) AS n_ids, count(*) AS n_rows FROM pr GROUP BY ALL UNION ALL
SELECT 'predicted', CAST(coalesce(len(po), 0) AS INT), count(*) FROM pr GROUP BY ALL UNION ALL
SELECT 'all_wrong', 0, count(*) FROM pr WHERE len(po) > 0 AND NOT list_has_any(po, gi) HAVING count(*) > 0""")
def citation_counts(load):
    return E.citation_counts(_pairs(load))


@add("A21_baseline_scores", (*ROUTER_VIEWS, "gold_messages"), ROUTED + """ SELECT count(*) AS total, count_if(r.action = g.action) AS action_correct,
  count_if(r.message_type = g.message_type) AS type_correct, count_if(r.action = g.action AND r.message_type = g.message_type) AS joint_correct
  FROM gold_messages g JOIN routed r ON g.message_id = r.message_id""")
def baseline_scores(load):
    filled = {"confidence": F.lit(0.5), "evidence_message_ids": F.lit("none")}
    pairs = E.pair_with_gold(load("gold_messages").withColumns(filled), route(routing_features(tables(load))).withColumns(filled))
    return E.metrics(pairs).select("total", "action_correct", "type_correct", "joint_correct")


# --- Reason scores --------------------------------------------------------------------------------
_JUDGED = """, marks AS (SELECT reason, action, message_type, seq, CAST(json_extract_string(response, '$.specificity') AS INT) AS s,
  CASE WHEN json_type(response, '$.consistency') = 'UBIGINT' THEN CAST(json_extract_string(response, '$.consistency') AS INT) END AS c,
  CASE WHEN CAST(json_extract_string(response, '$.register') AS INT) <= 3 THEN CAST(json_extract_string(response, '$.register') AS INT) END AS r FROM score_log),
firsts AS (SELECT reason, action, message_type, arg_min({'s': s, 'c': c, 'r': r}, seq) AS m FROM marks WHERE s IS NOT NULL AND c IS NOT NULL AND r IS NOT NULL GROUP BY ALL),
judged AS (SELECT w.message_id, m.s AS specificity, m.c AS consistency, m.r AS register, m.s + m.c + m.r AS total, m IS NULL AS failed
  FROM reason_rows w LEFT JOIN firsts f ON w.reason = f.reason AND w.action = f.action AND w.message_type = f.message_type)"""
_JUDGE_VIEWS = ("reason_rows", "score_log")


def _judged(load):
    return E.score_reasons(load("reason_rows"), load("score_log"))


@add("W08_scored_once", _JUDGE_VIEWS, _JUDGED + " SELECT message_id, specificity, consistency, register, failed FROM judged")
def scored_once(load):
    return _judged(load).select("message_id", "specificity", "consistency", "register", "failed")


@add("R18_reason_scoring", _JUDGE_VIEWS, _JUDGED + " SELECT message_id, total, round(total / 9.0, 6)::DOUBLE AS normalised FROM judged")
def reason_scoring(load):
    return rounded(_judged(load).select("message_id", "total", "normalised"))


@add("A20_judge_means", _JUDGE_VIEWS, _JUDGED + """ SELECT count(*) AS n_rows, count_if(failed) AS failures, round(avg(specificity), 6) AS mean_specificity,
  round(avg(consistency), 6) AS mean_consistency, round(avg(register), 6) AS mean_register, round(avg(total / 9.0), 6) AS mean_normalised FROM judged""")
def judge_means(load):
    return rounded(E.score_summary(_judged(load)))


@add("A20_total_distribution", _JUDGE_VIEWS, _JUDGED + " SELECT total, count(*) AS n_rows FROM judged WHERE NOT failed GROUP BY 1")
def total_distribution(load):
    return E.total_distribution(_judged(load))


@add("W06_worst_rows", _JUDGE_VIEWS, _JUDGED + " SELECT message_id, total FROM judged WHERE NOT failed ORDER BY total, message_id LIMIT 8")
def worst(load):
    return E.worst_rows(_judged(load)).select("message_id", "total")


@add("R15_evaluation_run", (*_VIEWS, *_JUDGE_VIEWS), METRICS + _JUDGED + """, quality AS (SELECT avg(total / 9.0) AS rq FROM judged WHERE NOT failed)
SELECT total, round(action_accuracy, 6) AS action_accuracy, round(evidence_f1, 6)::DOUBLE AS evidence_f1, round(rq, 6) AS reason_quality,
  round(0.35 * action_accuracy + 0.25 * type_accuracy + 0.15 * evidence_f1 + 0.15 * rq + 0.10 * (1.0 - calibration_error), 6)::DOUBLE AS composite FROM met, quality""")
def evaluation_run(load):
    out = evaluate(load("gold_samples"), load("prediction_samples"), E.score_summary(_judged(load)))
    return rounded(out.select("total", "action_accuracy", "evidence_f1", "reason_quality", "composite"))


# --- Set checks and the submitted file ----------------------------------------------------------------
@add("X01_id_difference", _VIEWS, """ SELECT coalesce(g.message_id, p.message_id) AS message_id, CASE WHEN p.message_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side
  FROM gold_samples g FULL JOIN prediction_samples p ON g.message_id = p.message_id WHERE g.message_id IS NULL OR p.message_id IS NULL""")
def id_difference(load):
    return contracts.id_difference(load("gold_samples"), load("prediction_samples"))


@add("X06_unique_key", ("output_rows",), " SELECT message_id, count(*) AS n FROM output_rows GROUP BY 1 HAVING count(*) > 1")
def unique_key(load):
    return contracts.duplicate_keys(load("output_rows"), ["message_id"])


_OUTPUT_VIEWS = ("output_rows", "messages", "history")
_OUTPUT = """, ex AS (SELECT line_number, trim(x) AS cited FROM (SELECT line_number, unnest(string_split(trim(evidence_message_ids), ';')) AS x FROM output_rows
  WHERE trim(evidence_message_ids) NOT IN ('', 'none'))),
unres AS (SELECT DISTINCT line_number, cited FROM ex WHERE cited NOT IN (SELECT message_id FROM history)),
dup AS (SELECT message_id FROM output_rows WHERE message_id <> '' GROUP BY 1 HAVING count(*) > 1),
orr AS (SELECT line_number, message_id, concat_ws('|', CASE WHEN contains(reason, chr(10)) THEN 'embedded newline in reason' END,
  CASE WHEN message_id = '' THEN 'blank message_id' END, CASE WHEN action NOT IN ('notify', 'digest', 'mute') THEN 'invalid action' END,
  CASE WHEN message_type = 'other' THEN 'invalid message_type' END, CASE WHEN contains(reason, chr(10)) THEN 'reason must be a single line' END,
  CASE WHEN confidence = 'high' THEN 'confidence is not a number' END, CASE WHEN confidence IN ('nan', '1.5') THEN 'confidence outside [0, 1]' END,
  CASE WHEN evidence_message_ids = '' THEN 'evidence missing' END, CASE WHEN line_number IN (SELECT line_number FROM unres) THEN 'unresolved evidence ids' END,
  CASE WHEN message_id IN (SELECT message_id FROM dup) THEN 'duplicate message_id' END,
  CASE WHEN message_id <> '' AND message_id NOT IN (SELECT message_id FROM messages) THEN 'unknown message_id' END) AS errors FROM output_rows)"""


@add("V06_output_contract", _OUTPUT_VIEWS, _OUTPUT + " SELECT line_number, message_id, errors FROM orr")
def output_contract(load):
    out = contracts.output_row_errors(load("output_rows"), load("messages"), load("history"))
    return out.select("line_number", "message_id", F.array_join("errors", "|").alias("errors"))


@add("J15_unresolved_evidence", _OUTPUT_VIEWS, _OUTPUT + " SELECT line_number FROM unres GROUP BY 1")
def unresolved(load):
    out = contracts.output_row_errors(load("output_rows"), load("messages"), load("history"))
    return out.filter(F.array_contains("errors", "unresolved evidence ids")).select("line_number")


@add("A24_output_counts", _OUTPUT_VIEWS, _OUTPUT + """ SELECT (SELECT count(*) FROM output_rows) AS row_count, (SELECT count(*) FROM dup) AS duplicate_ids,
  (SELECT count(*) FROM messages WHERE message_id NOT IN (SELECT message_id FROM output_rows)) AS missing_ids,
  (SELECT count(DISTINCT message_id) FROM output_rows WHERE message_id <> '' AND message_id NOT IN (SELECT message_id FROM messages)) AS extra_ids,
  (SELECT count(*) FROM messages) AS expected_ids, (SELECT count(*) FROM output_rows) = (SELECT count(*) FROM messages) AS row_count_ok,
  (SELECT count(*) FROM orr WHERE errors <> '') AS broken_rows, false AS ok""")
def output_counts(load):
    return output_verdict(load("output_rows"), load("messages"), load("history"))


@add("W05_template_order", ("decisions", "messages"), """ SELECT d.message_id, row_number() OVER (ORDER BY m.position) AS line
  FROM decisions d JOIN messages m ON d.message_id = m.message_id""")
def template_order(load):
    from triagelake.operators.similarity import number_in_order
    from triagelake.sources.sinks import in_template_order
    rows = in_template_order(load("decisions").select("message_id"), load("messages"))
    return number_in_order(rows, "position", "line").select("message_id", "line")


# --- Audits of finished runs ------------------------------------------------------------------------------
def _traces(load):
    rules = F.filter(F.split("rules_fired", ";"), lambda r: r != "")
    return load("traces").withColumns({"rules": rules, "action_changed": F.lit(False)})


@add("A16_gate_totals", ("traces",), """ SELECT count(*) AS n_traces, count_if(rules_fired <> '') AS fired_rows, count_if(pre_action <> post_action) AS changed_rows,
  count_if(hard_blocked) AS hard_blocked_rows FROM traces""")
def gate_totals(load):
    return audit.gate_totals(_traces(load))


@add("A16_gate_rules", ("traces",), """, x AS (SELECT unnest(string_split(rules_fired, ';')) AS rule, pre_action <> post_action AS ch FROM traces WHERE rules_fired <> '')
SELECT rule, count(*) AS fired, count_if(ch) AS changed FROM x GROUP BY 1""")
def gate_rules(load):
    return audit.gate_rules(_traces(load))


@add("A16_gate_distribution", ("traces",), f""" SELECT w AS action, (SELECT count(*) FROM traces WHERE pre_action = w) AS pre_gate,
  (SELECT count(*) FROM traces WHERE post_action = w) AS post_gate, (SELECT count(*) FROM traces WHERE post_action = w) - (SELECT count(*) FROM traces WHERE pre_action = w) AS delta
  FROM {_vocab(C.ACTIONS)} v(w)""")
def gate_distribution(load):
    return audit.gate_distribution(_traces(load))


@add("W09_transitions", ("traces",), " SELECT pre_action, post_action, count(*) AS n FROM traces WHERE pre_action <> post_action GROUP BY ALL ORDER BY n DESC")
def transitions(load):
    return audit.gate_transitions(_traces(load))


@add("A16_changed_rows", ("traces",), """ SELECT message_id, pre_action, post_action, CASE WHEN rules_fired = '' THEN '-' ELSE replace(rules_fired, ';', ', ') END AS rules
  FROM traces WHERE pre_action <> post_action""")
def changed_rows(load):
    return audit.changed_rows(_traces(load))


_RUN = """ SELECT count_if(NOT resumed) AS n_rows, count_if(resumed) AS resumed, count_if(NOT resumed AND outcome NOT IN ('submitted', 'reason_repaired')) AS fallbacks,
  count_if(NOT resumed AND outcome = 'refusal') AS refusals, CAST(sum(retries) FILTER (NOT resumed) AS BIGINT) AS retries, CAST(sum(coercions) FILTER (NOT resumed) AS BIGINT) AS coercions,
  CAST(sum(tool_calls) FILTER (NOT resumed) AS BIGINT) AS tool_calls, CAST(sum(inspect_calls) FILTER (NOT resumed) AS BIGINT) AS inspect_calls,
  CAST(sum(model_calls) FILTER (NOT resumed) AS BIGINT) AS model_calls, round(quantile_disc(wall_seconds, 0.95) FILTER (NOT resumed), 6) AS p95_seconds,
  round(sum(cache_read_tokens) FILTER (NOT resumed) / sum(input_tokens + cache_read_tokens + cache_write_tokens) FILTER (NOT resumed), 6)::DOUBLE AS cache_hit_rate,
  round(sum(tool_calls) FILTER (NOT resumed) / count_if(NOT resumed), 6)::DOUBLE AS mean_tool_calls FROM traces"""


@add("A17_run_counters", ("traces",), "SELECT * EXCLUDE (p95_seconds, cache_hit_rate, mean_tool_calls) FROM (" + _RUN + ") r")
def run_counters(load):
    return audit.run_counters(_traces(load)).drop("cache_hit_rate", "mean_tool_calls")


@add("A18_p95_latency", ("traces",), "SELECT p95_seconds FROM (" + _RUN + ") r")
def p95(load):
    return rounded(audit.tail_latency(_traces(load)))


@add("A19_run_rates", ("traces",), "SELECT cache_hit_rate, mean_tool_calls FROM (" + _RUN + ") r")
def run_rates(load):
    return rounded(audit.run_counters(_traces(load)).select("cache_hit_rate", "mean_tool_calls"))


@add("A17_counter_tables", ("traces",), """, f AS (SELECT * FROM traces WHERE NOT resumed) SELECT 'action' AS kind, post_action AS name, count(*) AS n FROM f GROUP BY ALL UNION ALL
SELECT 'outcome', outcome, count(*) FROM f GROUP BY ALL UNION ALL
SELECT 'gate_rule', r, count(*) FROM (SELECT unnest(string_split(rules_fired, ';')) AS r FROM f WHERE rules_fired <> '') x GROUP BY ALL""")
def counter_tables(load):
    return audit.counter_tables(_traces(load))


_FIRST = """ messages m WHERE m.conversation_type = 'personal' AND m.sender_user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM history h
  WHERE h.user_id = m.user_id AND h.sender_user_id = m.sender_user_id)"""


@add("J16_first_contact", ("messages", "history"), " SELECT message_id FROM" + _FIRST)
def first_contact(load):
    return audit.first_contacts(load("messages"), load("history")).select("message_id")


@add("A22_category_audit", ("messages", "history", "business_accounts", "user_business_history", "group_members", "decisions"), """, cat AS (
SELECT m.message_id, CASE WHEN regexp_matches(r.why_user_knows_account, 'old_|opted_out|_search|_interest|watchlist|ignored_') THEN 'A_dormant' ELSE 'A_active' END AS category
  FROM messages m JOIN business_accounts a ON m.conversation_type = 'business' AND m.business_id = a.business_id AND a.verified AND a.domain_used_by_sender = a.official_domain
  JOIN user_business_history r ON r.user_id = m.user_id AND r.business_id = m.business_id
UNION ALL SELECT message_id, 'B' FROM""" + _FIRST + """ UNION ALL SELECT m.message_id, 'C' FROM messages m JOIN group_members g
  ON m.conversation_type = 'group' AND g.group_id = m.group_id AND g.user_id = m.sender_user_id AND g.role = 'admin')
SELECT category, count(*) AS n, count_if(action = 'notify') AS notify, count_if(action = 'digest') AS digest, count_if(action = 'mute') AS mute, 0 AS MISSING
FROM cat JOIN decisions d ON cat.message_id = d.message_id GROUP BY 1""")
def category_audit(load):
    cats = audit.category_members(load("messages"), load("history"), load("business_accounts"), load("user_business_history"), load("group_members"))
    return audit.category_audit(cats, load("decisions"))


@add("A23_plan_profile", (*q.ENGAGED_VIEWS, "media"), PAIRS + """, offered AS (SELECT DISTINCT message_id FROM evd)
SELECT coalesce(media_type, 'text') AS media_type, count(*) AS n_rows, count_if(media_type = 'image' AND coalesce(x.file_exists, false)) AS inspectable_images,
  count_if(offered.message_id IS NULL) AS without_candidates FROM messages m LEFT JOIN media x ON m.media_type = x.kind AND m.media_id = x.media_id
  LEFT JOIN offered ON m.message_id = offered.message_id GROUP BY 1""")
def plan_profile(load):
    from triagelake.catalog.joins import _ranked
    from triagelake.operators.context import media_context
    rows = load("messages").join(media_context(load("messages"), load("media")), "message_id", "left").join(
        _ranked(load).select("message_id", "evidence"), "message_id", "left").withColumns(
        {"file_exists": F.coalesce("file_exists", F.lit(False)), "evidence": F.coalesce("evidence", F.array())})
    return audit.plan_profile(rows)
