"""Joins, point-in-time aggregates, ranking and the dossier."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.catalog import sqltext as q
from triagelake.catalog.registry import Registry, joined, rounded
from triagelake.catalog.scalars import DND_SQL, _RELEVANCE
from triagelake.operators import context as X, engagement as E
from triagelake.operators.retrieval import evidence_rows, rank_history
from triagelake.operators.running import median_before
from triagelake.plans.dossier import Tables, build_dossier, relationship, sender_identity

REGISTRY = Registry()
add = REGISTRY.add


def tables(load) -> Tables:
    return Tables.from_driver(load.spark, load.sf_dir)


def _sides(load):
    """Prepared messages (keys only) and history with its recorded reactions."""
    messages = E.prepare(load("messages")).select("message_id", "user_id", "peer_id", "at_us")
    return messages, E.with_events(E.prepare(load("history")), load("message_events"))


@add("J01_history_with_events", q.ENGAGED_VIEWS, q.ENGAGED + """ SELECT message_id, user_id, message_opened, message_replied,
  round(reaction_time_minutes, 6) AS reaction_time_minutes FROM he""")
def history_with_events(load):
    rows = E.with_events(load("history"), load("message_events")).filter("has_event")
    return rounded(rows.select("message_id", "user_id", F.col("opened").alias("message_opened"), F.col("replied").alias("message_replied"), "reaction_time_minutes"))


@add("J02_history_left_events", q.ENGAGED_VIEWS, """ SELECT h.message_id, e.message_id IS NOT NULL AS has_event, coalesce(e.message_opened, false) AS opened,
  coalesce(e.notification_dismissed, false) AS dismissed, coalesce(e.message_reported, false) AS reported
  FROM history h LEFT JOIN message_events e ON h.user_id = e.user_id AND h.message_id = e.message_id""")
def history_left_events(load):
    return E.with_events(load("history"), load("message_events")).select("message_id", "has_event", "opened", "dismissed", "reported")


def _engaged(name, keys, prefix, check):
    @add(name, q.ENGAGED_VIEWS, f"{q.ENGAGED}{check} SELECT message_id, {prefix}n, {prefix}n_reacted, {q.rounded_rates(prefix)} FROM {prefix}eng")
    def run(load):
        messages, history = _sides(load)
        return rounded(E.engagement_before(messages, history, keys, prefix))


_engaged("A01_peer_engagement", ["user_id", "peer_id"], "peer_", q.PEER_ENGAGEMENT)
_engaged("A02_global_engagement", ["peer_id"], "global_", q.GLOBAL_ENGAGEMENT)


@add("J03_point_in_time_peer", q.ENGAGED_VIEWS, q.ENGAGED + """ SELECT m.message_id, count(h.message_id) AS n_history
  FROM mp m LEFT JOIN hp h ON h.user_id = m.user_id AND h.peer_id = m.peer_id AND h.created_at < m.created_at GROUP BY 1""")
def point_in_time_peer(load):
    return _counted(load, ["user_id", "peer_id"])


@add("J04_point_in_time_global", q.ENGAGED_VIEWS, q.ENGAGED + """ SELECT m.message_id, count(h.message_id) AS n_history
  FROM mp m LEFT JOIN hp h ON h.peer_id = m.peer_id AND h.created_at < m.created_at GROUP BY 1""")
def point_in_time_global(load):
    return _counted(load, ["peer_id"])


def _counted(load, keys):
    from triagelake.operators.running import totals_before
    messages, history = _sides(load)
    facts = history.filter("peer_id IS NOT NULL").withColumn("n_history", F.lit(1))
    counts = totals_before(messages.filter("peer_id IS NOT NULL").select("message_id", *keys, "at_us"), facts, keys, ["n_history"])
    return messages.select("message_id").join(counts.select("message_id", "n_history"), "message_id", "left").fillna(0)


@add("J05_earlier_history", q.ENGAGED_VIEWS, """ SELECT m.message_id, count(h.message_id) AS n_history FROM messages m
  LEFT JOIN history h ON h.user_id = m.user_id AND h.created_at < m.created_at GROUP BY 1""")
def earlier_history(load):
    from triagelake.operators.running import totals_before
    messages, history = _sides(load)
    counts = totals_before(messages.select("message_id", "user_id", "at_us"), history.withColumn("n_history", F.lit(1)), ["user_id"], ["n_history"])
    return counts.select("message_id", "n_history")


BURST = """, burst AS (SELECT m.message_id, count(h.message_id) AS sender_burst_24h FROM mp m LEFT JOIN hp h ON h.user_id = m.user_id
  AND h.peer_id = m.peer_id AND h.created_at < m.created_at AND h.created_at >= m.created_at - INTERVAL 24 HOUR GROUP BY 1)"""


@add("J06_sender_burst", q.ENGAGED_VIEWS, q.ENGAGED + BURST + " SELECT * FROM burst")
def sender_burst(load):
    return E.sender_burst(*_sides(load))


@add("A06_burst_distribution", q.ENGAGED_VIEWS, q.ENGAGED + BURST + " SELECT sender_burst_24h, count(*) AS n FROM burst GROUP BY 1")
def burst_distribution(load):
    return E.sender_burst(*_sides(load)).groupBy("sender_burst_24h").agg(F.count("*").alias("n"))


_MEDIANS = q.ENGAGED + """ SELECT m.message_id, round(median(e.reaction_time_minutes), 6) AS median_minutes
  FROM mp m LEFT JOIN he e ON e.peer_id = m.peer_id AND e.created_at < m.created_at WHERE m.peer_id IS NOT NULL GROUP BY 1"""


def _medians(load, **limit):
    messages, history = _sides(load)
    asked = messages.filter("peer_id IS NOT NULL").select("message_id", "peer_id", "at_us")
    out = median_before(asked, history.filter("has_event AND peer_id IS NOT NULL"), ["peer_id"], "reaction_time_minutes", **limit)
    return rounded(out.select("message_id", F.col("median").alias("median_minutes")))


@add("A03_reaction_median", q.ENGAGED_VIEWS, _MEDIANS)
def reaction_median(load):
    """Global median per sender as shipped."""
    return _medians(load)


@add("A03_median_descent", q.ENGAGED_VIEWS, _MEDIANS)
def median_descent(load):
    """The same through the value descent, the way of senders with very many events."""
    return _medians(load, window_rows=24)


BASELINE = """, daily AS (SELECT user_id, sum(notifications_sent) AS s, sum(notifications_dismissed) AS d, count(*) AS n FROM daily_summary GROUP BY 1),
bl AS (SELECT u.user_id, do_not_disturb_window, messages_opened_30d AS baseline_messages_opened_30d, messages_replied_30d AS baseline_messages_replied_30d,
  notifications_dismissed_30d AS baseline_notifications_dismissed_30d, messages_reported_30d AS baseline_messages_reported_30d,
  CAST(coalesce(s, 0) AS BIGINT) AS baseline_notifications_sent_30d, CAST(coalesce(d, 0) AS BIGINT) AS baseline_notifications_dismissed_total, coalesce(n, 0) AS baseline_n_summary_days,
  d::DOUBLE / nullif(s, 0) AS baseline_dismiss_rate, s::DOUBLE / nullif(n, 0) AS baseline_mean_daily_notifications
  FROM users u LEFT JOIN daily ON u.user_id = daily.user_id)"""
_BASE_COLUMNS = ("baseline_messages_opened_30d", "baseline_messages_replied_30d", "baseline_notifications_dismissed_30d", "baseline_messages_reported_30d",
                 "baseline_notifications_sent_30d", "baseline_notifications_dismissed_total", "baseline_n_summary_days")


@add("J07_user_lookup", ("users", "messages"), """ SELECT m.message_id, u.do_not_disturb_window, coalesce(u.messages_opened_30d, 0) AS opened_30d
  FROM messages m LEFT JOIN users u ON m.user_id = u.user_id""")
def user_lookup(load):
    first = X.first_per_key(load("users"), "user_id").select("user_id", "do_not_disturb_window", F.col("messages_opened_30d").alias("opened_30d"))
    return load("messages").select("message_id", "user_id").join(first, "user_id", "left").select("message_id", "do_not_disturb_window", "opened_30d").fillna(0)


@add("A04_user_baseline", ("users", "daily_summary"), BASELINE + f""" SELECT user_id, {', '.join(_BASE_COLUMNS)},
  round(baseline_dismiss_rate, 6) AS baseline_dismiss_rate, round(baseline_mean_daily_notifications, 6) AS baseline_mean_daily_notifications FROM bl""")
def user_baseline(load):
    return rounded(X.user_baseline(load("users"), E.daily_totals(load("daily_summary"))).drop("do_not_disturb_window"))


_GROUP_COLUMNS = ("group_name", "group_type", "member_count", "admin_count", "group_messages_30d", "user_role", "sender_role", "group_muted_by_user",
                  "user_messages_sent_30d", "user_messages_read_30d", "user_replies_sent_30d", "user_notifications_dismissed_30d")
GROUPS = """, grp AS (SELECT m.message_id, g.group_name, g.group_type, g.member_count, g.admin_count, g.messages_30d AS group_messages_30d,
  r.role AS user_role, s.role AS sender_role, r.group_muted_by_user, r.messages_sent_30d AS user_messages_sent_30d, r.messages_read_30d AS user_messages_read_30d,
  r.replies_sent_30d AS user_replies_sent_30d, r.notifications_dismissed_30d AS user_notifications_dismissed_30d,
  r.messages_read_30d::DOUBLE / nullif(g.messages_30d, 0) AS group_read_rate, r.replies_sent_30d::DOUBLE / nullif(r.messages_read_30d, 0) AS group_reply_rate,
  r.notifications_dismissed_30d::DOUBLE / nullif(g.messages_30d, 0) AS group_dismiss_rate
  FROM messages m JOIN groups g ON m.group_id = g.group_id JOIN group_members r ON r.group_id = m.group_id AND r.user_id = m.user_id
  LEFT JOIN group_members s ON s.group_id = m.group_id AND s.user_id = m.sender_user_id WHERE m.conversation_type = 'group')"""
GROUP_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in ("group_read_rate", "group_reply_rate", "group_dismiss_rate"))


@add("J08_group_context", ("messages", "groups", "group_members"), GROUPS + f" SELECT message_id, {', '.join(_GROUP_COLUMNS)}, {GROUP_RATES} FROM grp")
def group_context(load):
    return rounded(X.group_context(load("messages"), load("groups"), load("group_members")).drop("group_id"))


@add("J09_account_lookup", ("messages", "business_accounts"), q.ACCOUNTS + """ SELECT m.message_id, a.brand_name, a.category, a.mm AS domain_mismatch, a.brand_verdict
  FROM messages m LEFT JOIN acc a ON m.conversation_type = 'business' AND m.business_id = a.business_id""")
def account_lookup(load):
    return sender_identity(load("messages"), load("business_accounts")).select("message_id", "brand_name", "category", "domain_mismatch", "brand_verdict")


BUSINESS = """, biz AS (SELECT m.message_id, r.why_user_knows_account, r.promotions_opted_out_at, r.promotions_opted_out_at IS NOT NULL AS opted_out,
  CAST(floor((epoch_us(m.created_at) - epoch_us(r.last_activity_at)) / 86400000000.0) AS INT) AS days_since_last_activity,
  r.messages_opened_30d::DOUBLE / nullif(r.messages_opened_30d + r.messages_dismissed_30d, 0) AS open_share
  FROM messages m JOIN user_business_history r ON m.conversation_type = 'business' AND m.user_id = r.user_id AND m.business_id = r.business_id)"""


@add("J10_business_relationship", ("messages", "user_business_history"), BUSINESS + """ SELECT message_id, why_user_knows_account, opted_out,
  days_since_last_activity, round(open_share, 6) AS open_share FROM biz""")
def business(load):
    return rounded(X.business_relationship(load("messages"), load("user_business_history")).select(
        "message_id", "why_user_knows_account", "opted_out", "days_since_last_activity", "open_share"))


MEDIA = """, med AS (SELECT m.message_id, x.file_path, coalesce(x.file_exists, false) AS file_exists, x.file_size_bytes FROM messages m
  LEFT JOIN media x ON m.media_type = x.kind AND m.media_id = x.media_id WHERE m.media_type IS NOT NULL)"""


@add("J11_media_lookup", ("messages", "media"), MEDIA + " SELECT * FROM med")
def media(load):
    return X.media_context(load("messages"), load("media"))


@add("S05_media_manifest", ("media",), """ SELECT kind, count(*) AS n, count_if(file_exists) AS present, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM media GROUP BY 1""")
def media_manifest(load):
    return load("media").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("file_exists").alias("present"), F.sum("file_size_bytes").alias("bytes"))


# --- Ranking over the recipient's earlier history ---------------------------------------------
_H_PEER = "h.peer_id IS NOT NULL AND h.peer_id = m.peer_id"
PAIRS = q.ENGAGED + f""",
mt AS (SELECT message_id, user_id, created_at, conversation_type, group_id, peer_id, {q.norm('message_text')} AS w FROM mp),
ht AS (SELECT message_id, user_id, created_at, conversation_type, group_id, peer_id, {q.norm('message_text')} AS w FROM hp),
mg AS (SELECT *, {q.grams('w')} AS g FROM mt), hg AS (SELECT *, {q.grams('w')} AS g FROM ht),
prs AS (SELECT m.message_id, h.message_id AS history_message_id, h.created_at AS h_at, h.conversation_type, h.peer_id, h.w,
  coalesce({_H_PEER}, false) AS same_peer, coalesce(m.conversation_type = 'group' AND h.conversation_type = 'group' AND m.group_id = h.group_id, false) AS same_group,
  {q.jac('m.g', 'h.g')} AS jac, (epoch_us(m.created_at) - epoch_us(h.created_at)) / 86400000000.0 AS days_ago,
  CASE WHEN e.message_id IS NULL THEN 0 ELSE {_RELEVANCE} END AS rel, coalesce(e.message_opened, false) AS opened, coalesce(e.message_replied, false) AS replied,
  coalesce(e.notification_dismissed, false) AS dismissed, coalesce(e.muted_after_message, false) AS muted_after, coalesce(e.message_reported, false) AS reported
  FROM mg m JOIN hg h ON h.user_id = m.user_id AND h.created_at < m.created_at
  LEFT JOIN message_events e ON e.user_id = h.user_id AND e.message_id = h.message_id),
scored AS (SELECT *, pow(0.5, days_ago / 30.0) AS recency, 0.35 * same_peer::INT + 0.25 * coalesce(jac, 0) + 0.15 * same_group::INT + 0.15 * rel
  + 0.10 * pow(0.5, days_ago / 30.0) AS score FROM prs),
evd AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, h_at DESC, history_message_id) AS rank FROM scored WHERE score >= 0.12 QUALIFY rank <= 6),
near AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY jac DESC, h_at DESC, history_message_id) AS rank FROM scored WHERE jac >= 0.45 QUALIFY rank <= 3)"""


def _ranked(load):
    return rank_history(E.prepare(load("messages")), E.with_events(E.prepare(load("history")), load("message_events")))


@add("R04_evidence", q.ENGAGED_VIEWS, PAIRS + """ SELECT message_id, rank, history_message_id, round(score, 6) AS score, same_peer, same_group, round(coalesce(jac, 0), 6) AS jaccard,
  round(rel, 6)::DOUBLE AS event_relevance, round(recency, 6) AS recency, h_at AS created_at, round(days_ago, 5) AS days_ago, conversation_type, peer_id,
  substr(w, 1, 160) AS text_excerpt, opened, replied, dismissed, muted_after, reported FROM evd""")
def evidence(load):
    return rounded(evidence_rows(_ranked(load)).withColumn("days_ago", F.round("days_ago", 5)))


@add("W02_evidence_order", q.ENGAGED_VIEWS, PAIRS + " SELECT message_id, string_agg(history_message_id, ',' ORDER BY rank) AS ids, count(*) AS n FROM evd GROUP BY 1")
def evidence_order(load):
    ids = F.transform("evidence", lambda e: e["history_message_id"])
    return _ranked(load).filter(F.size("evidence") > 0).select("message_id", joined(ids).alias("ids"), F.size("evidence").cast("long").alias("n"))


@add("W03_near_duplicates", q.ENGAGED_VIEWS, PAIRS + " SELECT message_id, rank, history_message_id, round(jac, 6) AS jaccard, same_peer, peer_id FROM near")
def near(load):
    return rounded(evidence_rows(_ranked(load), "near_duplicates").select("message_id", "rank", "history_message_id", "jaccard", "same_peer", "peer_id"))


@add("A05_repetition_figures", q.ENGAGED_VIEWS, PAIRS + """ SELECT m.message_id, round(max(jac), 6) AS max_jaccard, coalesce(count_if(jac >= 0.45), 0) AS duplicate_count
  FROM messages m LEFT JOIN prs p ON m.message_id = p.message_id GROUP BY 1""")
def repetition_figures(load):
    return rounded(_ranked(load).select("message_id", "max_jaccard", "duplicate_count"))


@add("R03_repetition", q.ENGAGED_VIEWS, PAIRS + BURST + """, figures AS (SELECT message_id, max(jac) AS mx, count_if(jac >= 0.45) AS n FROM prs GROUP BY 1),
tops AS (SELECT message_id, string_agg(history_message_id, ',' ORDER BY rank) AS ids FROM near GROUP BY 1)
SELECT m.message_id, round(mx, 6) AS max_jaccard, coalesce(n, 0) AS duplicate_count, coalesce(ids, '') AS near_ids, sender_burst_24h
FROM messages m LEFT JOIN figures f ON m.message_id = f.message_id LEFT JOIN tops t ON m.message_id = t.message_id JOIN burst b ON m.message_id = b.message_id""")
def repetition(load):
    ranked = _ranked(load).select("message_id", "max_jaccard", "duplicate_count",
                                  joined(F.transform("near_duplicates", lambda e: e["history_message_id"])).alias("near_ids"))
    return rounded(ranked.join(E.sender_burst(*_sides(load)), "message_id"))


@add("W01_history_order", q.ENGAGED_VIEWS, q.ENGAGED + """ SELECT message_id, row_number() OVER (PARTITION BY user_id, peer_id ORDER BY created_at, message_id) AS row_rank
  FROM hp WHERE peer_id IS NOT NULL""")
def history_order(load):
    rows = E.with_peer(load("history")).filter("peer_id IS NOT NULL")
    return X.ordered_by(rows, ["user_id", "peer_id"], ["created_at", "message_id"]).select("message_id", "row_rank")


RELATION = q.ENGAGED + q.PEER_ENGAGEMENT + q.GLOBAL_ENGAGEMENT


@add("R02_relationship", q.ENGAGED_VIEWS, RELATION + f""" SELECT p.message_id, peer_n, peer_n_reacted, {q.rounded_rates('peer_')}, global_n, global_n_reacted,
  {q.rounded_rates('global_')}, CASE WHEN peer_n > 0 THEN 'peer' WHEN global_n > 0 THEN 'global_fallback' ELSE 'none' END AS evidence_state
  FROM peer_eng p JOIN global_eng g ON p.message_id = g.message_id""")
def relation(load):
    return rounded(relationship(*_sides(load)).drop("peer_basis_note", "global_basis_note"))


DOSSIER_VIEWS = ("messages", "history", "message_events", "users", "groups", "group_members", "business_accounts", "user_business_history", "daily_summary", "media")
_DOSSIER_SQL = (RELATION + PAIRS[len(q.ENGAGED):] + BURST + q.signals().replace(",\ntxt AS", ",\nctxt AS").replace("FROM txt)", "FROM ctxt)")
                + q.ACCOUNTS + BASELINE + GROUPS + BUSINESS + MEDIA + DND_SQL
                + """, figures AS (SELECT message_id, max(jac) AS mx, count_if(jac >= 0.45) AS n FROM prs GROUP BY 1),
ev_ids AS (SELECT message_id, string_agg(history_message_id, ',' ORDER BY rank) AS evidence_ids FROM evd GROUP BY 1),
near_ids AS (SELECT message_id, string_agg(history_message_id, ',' ORDER BY rank) AS near_ids FROM near GROUP BY 1)""")


@add("R01_dossier", DOSSIER_VIEWS, _DOSSIER_SQL + f""" SELECT s.message_id, s.user_id, s.conversation_type, mp.peer_id, a.brand_name, a.mm AS domain_mismatch, a.brand_verdict,
  peer_n, peer_n_reacted, {q.rounded_rates('peer_')}, global_n, global_n_reacted, {q.rounded_rates('global_')},
  CASE WHEN peer_n > 0 THEN 'peer' WHEN global_n > 0 THEN 'global_fallback' ELSE 'none' END AS evidence_state,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in _BASE_COLUMNS)}, round(baseline_dismiss_rate, 6) AS baseline_dismiss_rate,
  round(baseline_mean_daily_notifications, 6) AS baseline_mean_daily_notifications,
  {', '.join('grp.' + c for c in _GROUP_COLUMNS)}, {GROUP_RATES}, biz.why_user_knows_account AS biz_why_user_knows_account,
  coalesce(biz.opted_out, false) AS opted_out, biz.days_since_last_activity, round(biz.open_share, 6) AS open_share,
  length(trim(s.message_text)) AS text_length, s.w <> '' AS text_scanned, s.injection_match, s.credential_request, s.payment_pressure, s.keyword_type,
  round(mx, 6) AS max_jaccard, coalesce(n, 0) AS duplicate_count, coalesce(near_ids, '') AS near_ids, coalesce(evidence_ids, '') AS evidence_ids, sender_burst_24h,
  s.media_type, coalesce(med.file_exists, false) AS file_exists, med.file_size_bytes, dnd.do_not_disturb_window AS dnd_window_raw, dnd_start, dnd_end, in_dnd,
  CASE WHEN in_dnd THEN (dnd_end - mn + 1440) % 1440 END AS minutes_until_dnd_ends
FROM sig s JOIN mp ON s.message_id = mp.message_id LEFT JOIN acc a ON s.conversation_type = 'business' AND s.business_id = a.business_id
JOIN peer_eng ON s.message_id = peer_eng.message_id JOIN global_eng ON s.message_id = global_eng.message_id LEFT JOIN bl ON s.user_id = bl.user_id
LEFT JOIN grp ON s.message_id = grp.message_id LEFT JOIN biz ON s.message_id = biz.message_id LEFT JOIN med ON s.message_id = med.message_id
JOIN dnd ON s.message_id = dnd.message_id JOIN burst ON s.message_id = burst.message_id LEFT JOIN figures ON s.message_id = figures.message_id
LEFT JOIN near_ids ON s.message_id = near_ids.message_id LEFT JOIN ev_ids ON s.message_id = ev_ids.message_id""")
def dossier(load):
    row = build_dossier(tables(load)).withColumns({
        "near_ids": joined(F.transform("near_duplicates", lambda e: e["history_message_id"])),
        "evidence_ids": joined(F.transform("evidence", lambda e: e["history_message_id"])),
    })
    rates = [f"{p}_{c}" for p in ("peer", "global") for c in ("n", "n_reacted", *q.RATE_COLUMNS)]
    return rounded(row.select(
        "message_id", "user_id", "conversation_type", "peer_id", "brand_name", "domain_mismatch", "brand_verdict", *rates, "evidence_state",
        *_BASE_COLUMNS, "baseline_dismiss_rate", "baseline_mean_daily_notifications", *_GROUP_COLUMNS, "group_read_rate", "group_reply_rate",
        "group_dismiss_rate", "biz_why_user_knows_account", "opted_out", "days_since_last_activity", "open_share", "text_length", "text_scanned",
        "injection_match", "credential_request", "payment_pressure", "keyword_type", "max_jaccard", "duplicate_count", "near_ids", "evidence_ids",
        "sender_burst_24h", "media_type", "file_exists", "file_size_bytes", "dnd_window_raw", "dnd_start", "dnd_end", "in_dnd", "minutes_until_dnd_ends"))
