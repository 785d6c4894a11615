"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake import config as C
from triagelake.catalog import sqltext as q
from triagelake.catalog.registry import Registry, joined, rounded
from triagelake.functions import detectors as D, reasons as R, scanners as S, scores as N, text as T, timewin as W, vocab as V
from triagelake.operators import audit, engagement as E
from triagelake.operators.brand import brand_integrity
from triagelake.operators.evaluation import judgement_total, parse_marks
from triagelake.operators.gate import detect
from triagelake.plans.dossier import content_signals

REGISTRY = Registry()
add = REGISTRY.add


@add("P01_peer_resolution", ("base",), f"""SELECT message_id, CASE WHEN conversation_type = 'business' THEN 'business' ELSE 'user' END
  AS peer_kind, {q.PEER} AS peer_id FROM base""")
def peer_resolution(load):
    return E.with_peer(load("base")).select("message_id", "peer_kind", "peer_id")


@add("P02_normalise_text", sql=f"""SELECT doc_id, md5({q.norm('text')}) AS words_md5, length({q.norm('text')}) AS n_words_chars FROM documents""")
def normalise(load):
    rows = load("documents").select("doc_id", T.normalise_text(F.col("text")).alias("w"))
    return rows.select("doc_id", F.md5("w").alias("words_md5"), F.length("w").alias("n_words_chars"))


@add("P03_guard_text", sql=f"""SELECT doc_id, md5({q.guard('text')}) AS guard_md5 FROM documents""")
def guard(load):
    return load("documents").select("doc_id", F.md5(T.guard_text(F.col("text"))).alias("guard_md5"))


@add("P04_trigrams", sql=f"""WITH w AS (SELECT doc_id, {q.norm('text')} AS w FROM documents), g AS (SELECT doc_id, {q.grams('w')} AS g FROM w)
SELECT doc_id, len(g) AS n_trigrams, md5(array_to_string(list_sort(g), '|')) AS trigrams_md5 FROM g""")
def trigrams(load):
    rows = load("documents").select("doc_id", T.trigrams(T.normalise_text(F.col("text"))).alias("g"))
    return rows.select("doc_id", F.size("g").alias("n_trigrams"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("trigrams_md5"))


@add("P05_jaccard", sql=f"""WITH w AS (SELECT conv_id, turn, {q.norm('text')} AS w FROM conversations), g AS (SELECT conv_id, turn, {q.grams('w')} AS g FROM w)
SELECT a.conv_id, a.turn, round({q.jac('a.g', 'b.g')}, 6) AS jaccard FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccard(load):
    g = load("conversations").select("conv_id", "turn", T.trigrams(T.normalise_text(F.col("text"))).alias("g"))
    after = g.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return rounded(g.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.jaccard(F.col("g"), F.col("h")).alias("jaccard")))


_URL = r"(?i)\b(?:https?://|www\.)([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?::\d+)?(?:[/?#\s),.!;:]|$)"


def _hosts(x: str) -> str:
    return (f"array_to_string(list_sort(list_distinct([regexp_replace(lower(h), '^www\\.', '') "
            f"for h in regexp_extract_all({x}, {q.quoted(_URL)}, 1)])), ',')")


@add("P06_url_domains", sql=f"SELECT page_id, {_hosts('url')} AS url_hosts, {_hosts('html')} AS html_hosts FROM pages")
def url_domains(load):
    return load("pages").select("page_id", joined(T.url_domains(F.col("url"))).alias("url_hosts"),
                                joined(T.url_domains(F.col("html"))).alias("html_hosts"))


@add("P07_domain_mismatch", ("business_accounts",), f"""SELECT business_id, {q.domain('official_domain')} AS official,
  {q.domain('domain_used_by_sender')} AS used, {q.MISMATCH} AS mismatch FROM business_accounts""")
def domain_mismatch(load):
    o, u = F.col("official_domain"), F.col("domain_used_by_sender")
    return load("business_accounts").select("business_id", T.normalise_domain(o).alias("official"), T.normalise_domain(u).alias("used"),
                                            T.domain_mismatch(o, u).alias("mismatch"))


@add("P08_brand_verdict", ("business_accounts",), f"""SELECT business_id, {q.verdict()} AS brand_verdict, concat_ws(',',
  CASE WHEN official_domain IS NULL THEN 'official_domain_absent' END, CASE WHEN mm THEN 'domain_mismatch' END,
  CASE WHEN NOT verified THEN 'unverified' END, CASE WHEN account_age_days < 365 THEN 'account_new' END,
  CASE WHEN domain_used_by_sender_age_days < 180 THEN 'sender_domain_new' END,
  CASE WHEN user_reports_30d > 29 THEN 'reported_by_users' END) AS basis
  FROM (SELECT *, {q.MISMATCH} AS mm FROM business_accounts) b""")
def brand(load):
    return brand_integrity(load("business_accounts")).select("business_id", "brand_verdict", joined("verdict_basis").alias("basis"))


@add("P09_scanners", ("base",), f"""{q.signals('base')}
SELECT message_id, injection_match, credential_request, payment_pressure FROM sig""")
def scanners(load):
    w = F.col("w")
    return load("base").select("message_id", T.normalise_text(F.col("message_text")).alias("w")).select(
        "message_id", *[F.when(w != "", f(w)).alias(n) for n, f in (
            ("injection_match", S.scan_injection), ("credential_request", S.scan_credential), ("payment_pressure", S.scan_payment))])


def _guarded(load):
    """The guard form as a column of its own: worked out once, however often a detector reads it."""
    return load("base").select("message_id", T.guard_text(F.col("message_text")).alias("g"))


@add("P10_injection_detector", ("base",), f"""{q.detected('base')} SELECT message_id, attack_phrase FROM det""")
def injection(load):
    return _guarded(load).select("message_id", D.looks_like_injection(F.col("g")).alias("attack_phrase"))


@add("P10_injection_turns", sql=f"""SELECT conv_id, turn, {q.attack(q.guard('text'))} AS attack_phrase FROM conversations""")
def injection_turns(load):
    return load("conversations").select("conv_id", "turn", D.looks_like_injection(T.guard_text(F.col("text"))).alias("attack_phrase"))


@add("P11_credential_solicitation", ("base",), f"""{q.detected('base')} SELECT message_id, credential_phrase FROM det""")
def credential(load):
    return _guarded(load).select("message_id", D.asks_for_credential(F.col("g")).alias("credential_phrase"))


@add("P12_payment_demand", ("base",), f"""{q.detected('base')} SELECT message_id, payment_phrase FROM det""")
def payment(load):
    return _guarded(load).select("message_id", D.demands_payment(F.col("g")).alias("payment_phrase"))


@add("P13_negation_lookback", ("base",), f""", n AS (SELECT message_id, {q.guard("concat('never ', message_text, ' ', message_text)")} AS g FROM base)
SELECT n.message_id, {q.credential('n.g')} AS negated_credential, {q.payment('n.g')} AS negated_payment FROM n""")
def negation(load):
    """Every text twice, the first time behind a negation: its reach ends before the second one."""
    rows = load("base").withColumn("message_text", F.concat(F.lit("never "), "message_text", F.lit(" "), "message_text"))
    return detect(rows).select("message_id", F.col("credential_phrase").alias("negated_credential"), F.col("payment_phrase").alias("negated_payment"))


_DND_PARTS = """, p AS (SELECT *, TRY_CAST(regexp_extract(do_not_disturb_window, '^\\s*(\\d{1,2}):(\\d{1,2})\\s*-\\s*(\\d{1,2}):(\\d{1,2})\\s*$', 1) AS INT) AS h1,
  TRY_CAST(regexp_extract(do_not_disturb_window, '^\\s*(\\d{1,2}):(\\d{1,2})\\s*-\\s*(\\d{1,2}):(\\d{1,2})\\s*$', 2) AS INT) AS m1,
  TRY_CAST(regexp_extract(do_not_disturb_window, '^\\s*(\\d{1,2}):(\\d{1,2})\\s*-\\s*(\\d{1,2}):(\\d{1,2})\\s*$', 3) AS INT) AS h2,
  TRY_CAST(regexp_extract(do_not_disturb_window, '^\\s*(\\d{1,2}):(\\d{1,2})\\s*-\\s*(\\d{1,2}):(\\d{1,2})\\s*$', 4) AS INT) AS m2 FROM users),
w AS (SELECT user_id, do_not_disturb_window, h1 * 60 + m1 AS dnd_start, h2 * 60 + m2 AS dnd_end FROM p)"""
DND_SQL = _DND_PARTS + """, t AS (SELECT m.message_id, m.user_id, w.*, hour(m.created_at) * 60 + minute(m.created_at) AS mn
  FROM messages m LEFT JOIN w ON m.user_id = w.user_id),
dnd AS (SELECT *, CASE WHEN dnd_start IS NULL OR dnd_start = dnd_end THEN false WHEN dnd_start < dnd_end THEN mn >= dnd_start AND mn < dnd_end
  ELSE mn >= dnd_start OR mn < dnd_end END AS in_dnd FROM t)"""


@add("P14_dnd_window", ("users",), _DND_PARTS + " SELECT user_id, dnd_start, dnd_end FROM w")
def dnd_window(load):
    start, end = W.dnd_bounds(F.col("do_not_disturb_window"))
    return load("users").select("user_id", start.alias("dnd_start"), end.alias("dnd_end"))


@add("P15_dnd_state", ("users", "messages"), DND_SQL + """ SELECT message_id, in_dnd, coalesce(dnd_start > dnd_end, false) AS wraps,
  CASE WHEN in_dnd THEN (dnd_end - mn + 1440) % 1440 END AS minutes_left FROM dnd""")
def dnd_state(load):
    rows = load("messages").join(load("users").select("user_id", "do_not_disturb_window"), "user_id", "left")
    state = W.dnd_columns(F.col("created_at"), F.col("do_not_disturb_window"))
    return rows.select("message_id", state["in_dnd"].alias("in_dnd"), state["dnd_wraps_midnight"].alias("wraps"),
                       state["minutes_until_dnd_ends"].alias("minutes_left"))


@add("P16_null_safe_rate", ("groups", "group_members"), """SELECT m.group_id, m.user_id,
  round(m.messages_read_30d::DOUBLE / nullif(g.messages_30d, 0), 6) AS read_rate,
  round(m.replies_sent_30d::DOUBLE / nullif(m.messages_read_30d, 0), 6) AS reply_rate FROM group_members m JOIN groups g ON m.group_id = g.group_id""")
def null_safe_rate(load):
    rows = load("group_members").alias("m").join(load("groups").select("group_id", F.col("messages_30d").alias("g30")), "group_id")
    return rounded(rows.select("group_id", "user_id", N.rate(F.col("messages_read_30d"), F.col("g30")).alias("read_rate"),
                               N.rate(F.col("replies_sent_30d"), F.col("messages_read_30d")).alias("reply_rate")))


_RELATED = ("messages", "user_business_history")
_RELATED_SQL = """ FROM messages m JOIN user_business_history r ON m.user_id = r.user_id AND m.business_id = r.business_id"""


@add("P17_recency", _RELATED, """SELECT m.message_id, round((epoch_us(m.created_at) - epoch_us(r.last_activity_at)) / 86400000000.0, 6) AS days_ago,
  round(pow(0.5, greatest(0, (epoch_us(m.created_at) - epoch_us(r.last_activity_at)) / 86400000000.0) / 30.0), 6) AS recency""" + _RELATED_SQL
     + " WHERE r.last_activity_at IS NOT NULL")
def recency(load):
    rows = load("messages").join(load("user_business_history"), ["user_id", "business_id"]).filter("last_activity_at IS NOT NULL")
    days = W.days_between(F.col("created_at"), F.col("last_activity_at"))
    return rounded(rows.select("message_id", days.alias("days_ago"), W.recency(days, C.RECENCY_HALF_LIFE_DAYS).alias("recency")))


@add("P18_whole_days", _RELATED, """SELECT m.message_id,
  CAST(floor((epoch_us(m.created_at) - epoch_us(r.last_activity_at)) / 86400000000.0) AS INT) AS whole_days""" + _RELATED_SQL)
def whole_days(load):
    rows = load("messages").join(load("user_business_history"), ["user_id", "business_id"])
    return rows.select("message_id", W.whole_days_between(F.col("created_at"), F.col("last_activity_at")).alias("whole_days"))


_RELEVANCE = """greatest(CASE WHEN message_reported THEN 1.0 ELSE 0 END, CASE WHEN muted_after_message THEN 0.9 ELSE 0 END,
  CASE WHEN message_replied THEN 0.7 ELSE 0 END, CASE WHEN notification_dismissed THEN 0.6 ELSE 0 END, CASE WHEN message_opened THEN 0.3 ELSE 0 END)"""


@add("P19_event_relevance", ("message_events",), f"SELECT message_id, CAST({_RELEVANCE} AS DOUBLE) AS relevance FROM message_events")
def event_relevance(load):
    flags = [F.col(c) for c in ("message_opened", "message_replied", "notification_dismissed", "muted_after_message", "message_reported")]
    return load("message_events").select("message_id", N.event_relevance(*flags).alias("relevance"))


@add("P20_evidence_score", ("cited_messages", "history", "message_events"), f""", txt AS (SELECT c.message_id, c.cite_id,
  c.created_at AS m_at, h.created_at AS h_at, {q.norm('c.message_text')} AS x, {q.norm('h.message_text')} AS y,
  coalesce(c.group_id = h.group_id, false) AS same_group, CASE WHEN e.message_id IS NOT NULL THEN {_RELEVANCE} ELSE 0 END AS rel
  FROM cited_messages c JOIN history h ON c.cite_id = h.message_id LEFT JOIN message_events e ON e.message_id = h.message_id AND e.user_id = h.user_id),
pair AS (SELECT *, {q.grams('x')} AS a, {q.grams('y')} AS b FROM txt)
SELECT message_id, cite_id, round(0.35 + 0.25 * coalesce({q.jac('a', 'b')}, 0) + 0.15 * same_group::INT + 0.15 * rel
  + 0.10 * pow(0.5, (epoch_us(m_at) - epoch_us(h_at)) / 86400000000.0 / 30.0), 6) AS score FROM pair""")
def evidence_score(load):
    """Score of the cited row, which shares the sender by construction."""
    h = E.with_events(load("history"), load("message_events")).select(
        F.col("message_id").alias("cite_id"), F.col("created_at").alias("h_at"), F.col("message_text").alias("h_text"),
        F.col("group_id").alias("h_group"), "opened", "replied", "dismissed", "muted_after", "reported")
    rows = load("cited_messages").select("message_id", "cite_id", "created_at", "message_text", "group_id").join(h, "cite_id")
    grams = [T.trigrams(T.normalise_text(F.col(c))) for c in ("message_text", "h_text")]
    score = N.evidence_score(
        F.lit(True), T.jaccard(*grams), F.coalesce(F.col("group_id") == F.col("h_group"), F.lit(False)),
        N.event_relevance(*[F.col(c) for c in ("opened", "replied", "dismissed", "muted_after", "reported")]),
        W.recency(W.days_between(F.col("created_at"), F.col("h_at")), C.RECENCY_HALF_LIFE_DAYS))
    return rounded(rows.select("message_id", "cite_id", score.alias("score")))


@add("P21_content_signals", ("base",), f"""{q.signals('base')} SELECT message_id, length(trim(message_text)) AS text_length,
  length(trim(message_text)) = 0 AS is_empty_text, w <> '' AS text_scanned, forwarded_count > 0 AS is_forwarded,
  {_hosts('message_text')} AS url_domains, injection_match, credential_request, payment_pressure FROM sig""")
def signals(load):
    return content_signals(load("base")).select(
        "message_id", "text_length", "is_empty_text", "text_scanned", "is_forwarded", joined("url_domains").alias("url_domains"),
        "injection_match", "credential_request", "payment_pressure")


@add("P22_evidence_state", ("users",), """, n AS (SELECT user_id, messages_replied_30d % 3 AS p, messages_reported_30d % 2 AS g FROM users)
SELECT user_id, CASE WHEN p > 0 THEN 'peer' WHEN g > 0 THEN 'global_fallback' ELSE 'none' END AS state,
  CASE WHEN p > 0 THEN concat('Computed over ', p, ' earlier messages this user received from this sender.')
  ELSE 'This user has never received a message from this sender. No per-user rates exist; all rates below are null.' END AS peer_note,
  CASE WHEN g > 0 THEN concat('FALLBACK — weaker evidence: this sender''s behaviour across all ', g, ' messages it sent to any user, not to this user.')
  ELSE 'FALLBACK unavailable: this sender does not appear anywhere in message history.' END AS global_note FROM n""")
def evidence_state(load):
    p, g = F.col("messages_replied_30d") % 3, F.col("messages_reported_30d") % 2
    return load("users").select("user_id", E.evidence_state(p, g).alias("state"), E.peer_basis_note(p).alias("peer_note"),
                                E.global_basis_note(g).alias("global_note"))


@add("P23_formatting", ("users", "user_business_history"), f"""SELECT r.user_id, r.business_id,
  {q.percent('r.messages_opened_30d::DOUBLE / r.activity_count_180d')} AS pct, {q.plural('r.activity_count_180d', 'previous message')} AS counted,
  trim(replace(r.why_user_knows_account, '_', ' ')) AS humanised,
  {q.cut("concat(r.why_user_knows_account, ' of ', r.user_id, ' with ', r.business_id, ' seen')", 44)} AS quoted FROM user_business_history r""")
def formatting(load):
    phrase = F.concat("why_user_knows_account", F.lit("  of "), "user_id", F.lit(" with  "), "business_id", F.lit(" seen"))
    n = F.col("activity_count_180d")
    return load("user_business_history").select(
        "user_id", "business_id", R.percent(N.rate(F.col("messages_opened_30d"), n)).alias("pct"), R.plural(n, "previous message").alias("counted"),
        R.humanise(F.col("why_user_knows_account")).alias("humanised"), R.quote_trim(phrase).alias("quoted"))


@add("P24_action_lattice", ("decisions", "gold_messages"), f"""SELECT d.message_id, list_extract(['notify', 'digest', 'mute'],
  greatest({q.severity('d.action')}, {q.severity('g.action')})) AS toward_mute,
  CASE WHEN d.message_type = 'scam' THEN 'scam' ELSE g.message_type END AS escalated FROM decisions d JOIN gold_messages g ON d.message_id = g.message_id""")
def lattice(load):
    gold = load("gold_messages").select("message_id", F.col("action").alias("ga"), F.col("message_type").alias("gt"))
    return load("decisions").join(gold, "message_id").select(
        "message_id", N.toward_mute(F.col("action"), F.col("ga")).alias("toward_mute"), N.escalate_type(F.col("message_type"), F.col("gt")).alias("escalated"))


@add("P25_calibrated_confidence", ("decisions",), f""", c AS (SELECT message_id, confidence - CASE WHEN media_mismatch THEN 0.05::DOUBLE ELSE 0 END
  - CASE WHEN risk = 'suspect' THEN 0.05::DOUBLE ELSE 0 END AS c, action FROM decisions)
SELECT message_id, {q.clamp("CASE WHEN action = 'mute' THEN least(c, 0.85::DOUBLE) ELSE c END")} AS confidence FROM c""")
def calibrated(load):
    return load("decisions").select("message_id", N.calibrate_confidence(
        F.col("confidence"), F.col("media_mismatch"), F.col("risk") == "suspect", F.col("action") == "mute").alias("confidence"))


_CLAIM = "This user dismisses 100% of the 4 previous messages from this sender."


@add("P26_restatement", ("decisions",), f"""SELECT message_id, {q.restates(q.quoted(_CLAIM), 'reason')} AS restated,
  array_to_string(list_sort({q.content_words('reason')}), ',') AS words FROM decisions""")
def restatement(load):
    return load("decisions").select("message_id", R.restates(F.lit(_CLAIM), F.col("reason")).alias("restated"),
                                    joined(F.array_sort(R.content_words(F.col("reason")))).alias("words"))


_REASONS = ", r AS (SELECT message_id, json_extract_string(payload, '$.reason') AS reason FROM raw_decisions)"


@add("P27_single_sentence", ("raw_decisions",), f"{_REASONS} SELECT message_id, {q.single_sentence('reason')} AS single FROM r")
def single_sentence(load):
    return load("raw_decisions").select("message_id", R.is_single_sentence(F.get_json_object("payload", "$.reason")).alias("single"))


@add("P28_reason_contract", ("raw_decisions",), f"{_REASONS} SELECT message_id, {q.style_codes('reason')} AS codes FROM r")
def reason_contract(load):
    return load("raw_decisions").select("message_id", joined(R.reason_issues(F.get_json_object("payload", "$.reason"))).alias("codes"))


@add("P28_reason_contract_documents", sql=f"SELECT doc_id, {q.style_codes('text')} AS codes FROM documents")
def reason_contract_documents(load):
    return load("documents").select("doc_id", joined(R.reason_issues(F.col("text"))).alias("codes"))


def vocab_sql(x: str, words) -> str:
    """value|tier of the three-tier vocabulary match."""
    import re
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    normal = f"replace(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), ' ', '_')"
    tokens = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    scored = ", ".join(
        f"CASE WHEN list_has_all({tokens}, [{', '.join(repr(p) for p in re.findall('[a-z0-9]+', w))}]) "
        f"THEN {{'t': {len(set(re.findall('[a-z0-9]+', w)))}, 'c': {len(w)}, 'w': '{w}'}} END" for w in words)
    hits = f"[h for h in [{scored}] if h IS NOT NULL]"
    best = f"list_max({hits})"
    ties = f"len([h for h in {hits} if h.t = {best}.t AND h.c = {best}.c])"
    return (f"CASE WHEN {x} IS NULL THEN '|invalid' WHEN list_contains({listed}, {x}) THEN concat({x}, '|exact') "
            f"WHEN list_contains({listed}, {normal}) THEN concat({normal}, '|normalised') WHEN len({hits}) = 0 THEN '|invalid' "
            f"WHEN {ties} > 1 THEN '|ambiguous' ELSE concat({best}.w, '|token_subset') END")


@add("P29_vocabulary_coercion", ("raw_decisions",), f""", r AS (SELECT message_id, json_extract_string(payload, '$.action') AS a,
  json_extract_string(payload, '$.message_type') AS t FROM raw_decisions)
SELECT message_id, {vocab_sql('a', C.ACTIONS)} AS action, {vocab_sql('t', C.MESSAGE_TYPES)} AS message_type FROM r""")
def vocabulary(load):
    def pair(name, words):
        c = V.coerce_vocabulary(F.get_json_object("payload", f"$.{name}"), words)
        return F.concat_ws("|", F.coalesce(c["value"], F.lit("")), c["tier"]).alias(name)
    return load("raw_decisions").select("message_id", pair("action", C.ACTIONS), pair("message_type", C.MESSAGE_TYPES))


@add("P30_confidence_and_evidence", ("output_rows",), """SELECT line_number, CASE WHEN TRY_CAST(confidence AS DOUBLE) BETWEEN 0 AND 1
  THEN CAST(confidence AS DOUBLE) END AS confidence,
  CASE WHEN evidence_message_ids = 'none' THEN '' WHEN evidence_message_ids = '' OR contains(evidence_message_ids, ' ')
    OR evidence_message_ids LIKE 'none;%' THEN NULL ELSE replace(evidence_message_ids, ';', ',') END AS strict_ids,
  CASE WHEN evidence_message_ids = 'none' THEN '' WHEN evidence_message_ids = '' OR evidence_message_ids LIKE 'none;%' THEN NULL
    ELSE array_to_string(list_sort(list_distinct([trim(p) for p in string_split(evidence_message_ids, ';')])), ',') END AS id_set
  FROM output_rows""")
def confidence_and_evidence(load):
    e = F.col("evidence_message_ids")
    return load("output_rows").select("line_number", V.parse_confidence(F.col("confidence")).alias("confidence"),
                                      joined(V.parse_evidence_strict(e)).alias("strict_ids"), joined(V.parse_evidence_set(e)).alias("id_set"))


_AXES = ", r AS (SELECT message_id, json_extract_string(payload, '$.risk_axis') AS k, json_extract_string(payload, '$.relevance_axis') AS l, json_extract_string(payload, '$.urgency_axis') AS u FROM raw_decisions)"


@add("P31_axis_aliases", ("raw_decisions",), _AXES + """ SELECT message_id, CASE WHEN k = 'clean' THEN 'clean' WHEN k IN ('suspect', 'suspicious')
  THEN 'suspect' WHEN k IN ('unsafe', 'scam_or_unsafe') THEN 'unsafe' END AS risk, CASE WHEN l IN ('high', 'wanted', 'relevant') THEN 'high'
  WHEN l IN ('medium', 'neutral') THEN 'medium' WHEN l IN ('low', 'unwanted') THEN 'low' END AS relevance FROM r""")
def axis_aliases(load):
    p = lambda n: F.get_json_object("payload", f"$.{n}")
    return load("raw_decisions").select("message_id", V.lookup(p("risk_axis"), C.RISK_AXES).alias("risk"),
                                        V.lookup(p("relevance_axis"), C.RELEVANCE_AXES).alias("relevance"))


@add("P32_axis_resolution", ("decisions",), """SELECT message_id, CASE WHEN risk = 'unsafe' THEN 'mute' WHEN urgency <> 'none' AND relevance <> 'low'
  THEN 'notify' WHEN relevance = 'low' THEN 'mute' ELSE 'digest' END AS action FROM decisions""")
def axis_resolution(load):
    return load("decisions").select("message_id", V.resolve_axes(F.col("risk"), F.col("relevance"), F.col("urgency")).alias("action"))


@add("P33_lexical_predicates", ("base",), f"{q.signals('base')} SELECT message_id, is_promotional, has_mention, has_deadline FROM sig")
def predicates(load):
    return content_signals(load("base")).select("message_id", "is_promotional", "has_mention", "has_deadline")


@add("P34_keyword_type", ("base",), f"{q.signals('base')} SELECT message_id, keyword_type FROM sig")
def keyword_type(load):
    return content_signals(load("base")).select("message_id", "keyword_type")


@add("P35_active_relationship", ("user_business_history",), """SELECT user_id, business_id, why_user_knows_account <> '' AND NOT regexp_matches(
  why_user_knows_account, 'old_|opted_out|_search|_interest|watchlist|ignored_') AS active FROM user_business_history""")
def active(load):
    return load("user_business_history").select("user_id", "business_id", S.is_active_relationship(F.col("why_user_knows_account")).alias("active"))


@add("P36_fingerprint", ("base",), """SELECT message_id, substr(sha256(CAST(json_object('message_id', message_id, 'user_id', user_id,
  'group_id', group_id, 'message_text', message_text) AS VARCHAR)), 1, 16) AS fingerprint FROM base""")
def fingerprint(load):
    return load("base").select("message_id", V.fingerprint(*[F.col(c) for c in ("message_id", "user_id", "group_id", "message_text")]).alias("fingerprint"))


@add("P37_media_mismatch", ("raw_decisions",), """SELECT message_id, coalesce(json_extract_string(payload, '$.media_observation.corroborates_message_claim')
  IN ('no', 'partial'), false) AS media_mismatch, json_extract_string(payload, '$.media_observation.mismatch_reason') AS why FROM raw_decisions""")
def media_mismatch(load):
    verdict = F.get_json_object("payload", "$.media_observation.corroborates_message_claim")
    return load("raw_decisions").select("message_id", V.media_mismatch(verdict).alias("media_mismatch"),
                                        F.get_json_object("payload", "$.media_observation.mismatch_reason").alias("why"))


@add("P39_excerpt", sql=f"SELECT doc_id, substr({q.norm('text')}, 1, 160) AS excerpt FROM documents")
def excerpt(load):
    return load("documents").select("doc_id", T.excerpt(T.normalise_text(F.col("text"))).alias("excerpt"))


PRICES = {"large": (5.0, 25.0), "small": (1.0, 5.0)}


@add("P40_token_cost", ("traces",), """, t AS (SELECT model, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS r,
  sum(cache_write_tokens) AS w FROM traces WHERE NOT resumed GROUP BY model)
SELECT model, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(r AS BIGINT) AS cache_read_tokens, CAST(w AS BIGINT) AS cache_write_tokens,
  round(CASE model WHEN 'large' THEN ((i + r * 0.1 + w * 1.25) * 5 + o * 25) / 1000000.0
  WHEN 'small' THEN ((i + r * 0.1 + w * 1.25) * 1 + o * 5) / 1000000.0 END, 6)::DOUBLE AS cost, model NOT IN ('large', 'small') AS unpriced FROM t""")
def token_cost(load):
    return rounded(audit.model_costs(load("traces"), PRICES))


@add("P41_iso_timestamps", sql="SELECT event_id, ts AS parsed FROM events")
def iso(load):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return load("events").select("event_id", W.parse_iso(text).alias("parsed"))


_MARKS = """, m AS (SELECT seq, CAST(json_extract_string(response, '$.specificity') AS INT) AS s,
  CASE WHEN json_type(response, '$.consistency') = 'UBIGINT' THEN CAST(json_extract_string(response, '$.consistency') AS INT) END AS c,
  CASE WHEN CAST(json_extract_string(response, '$.register') AS INT) <= 3 THEN CAST(json_extract_string(response, '$.register') AS INT) END AS r,
  coalesce(json_extract_string(response, '$.note'), '') AS note FROM score_log)"""


@add("P42_judged_total", ("score_log",), _MARKS + " SELECT seq, s + c + r AS total, round((s + c + r) / 9.0, 6)::DOUBLE AS normalised FROM m")
def judged_total(load):
    total, normalised = judgement_total(F.col("specificity"), F.col("consistency"), F.col("register"))
    return rounded(parse_marks(load("score_log")).select("seq", total.alias("total"), normalised.alias("normalised")))


@add("P43_score_check", ("score_log",), _MARKS + " SELECT seq, s AS specificity, c AS consistency, r AS register, note, s IS NULL OR c IS NULL OR r IS NULL AS failed FROM m")
def score_check(load):
    return parse_marks(load("score_log")).select("seq", "specificity", "consistency", "register", "note", "failed")
