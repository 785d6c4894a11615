"""Fragments of the checking SQL, written without the package's own operators."""

from __future__ import annotations

from triagelake.functions import detectors as D, scanners as S


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def guard(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[\\t\\n\\r ]+', ' ', 'g'))"


def cut(x: str, n: int = 80) -> str:
    return f"CASE WHEN length({x}) > {n} THEN concat(substr({x}, 1, {n}), '…') ELSE {x} END"


def first_of(x: str, patterns) -> str:
    parts = ", ".join(f"nullif(regexp_extract({x}, {quoted(p)}, 0), '')" for p in patterns)
    return f"coalesce({parts})"


def scan(x: str, patterns) -> str:
    return cut(first_of(x, patterns))


def grams(x: str) -> str:
    """Distinct trigrams of a column as a list."""
    return f"list_distinct([{x}[i:i + 2] for i in range(1, length({x}) - 1)])"


def jac(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) END"


def domain(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '^www\\.', '')"


MISMATCH = (
    "CASE WHEN official_domain IS NOT NULL AND domain_used_by_sender IS NOT NULL THEN NOT ("
    f"{domain('domain_used_by_sender')} = {domain('official_domain')} OR "
    f"ends_with({domain('domain_used_by_sender')}, concat('.', {domain('official_domain')}))) END"
)


def verdict(age=365, domain_age=180, reports=29) -> str:
    """Over a relation with the account columns and ``mm`` for the mismatch."""
    return (
        f"CASE WHEN coalesce(mm, false) AND NOT verified AND account_age_days < {age} AND "
        f"domain_used_by_sender_age_days < {domain_age} AND user_reports_30d > {reports} THEN 'impersonation' "
        f"WHEN coalesce(mm, false) OR (mm IS NULL AND NOT verified) OR user_reports_30d > {reports} THEN 'suspect' "
        "WHEN verified IS NOT NULL THEN 'clean' END"
    )


PEER = "CASE WHEN conversation_type = 'business' THEN business_id ELSE sender_user_id END"

# Messages and history with their sender; history with its recorded reaction.
ENGAGED = f""",
mp AS (SELECT *, {PEER} AS peer_id FROM messages),
hp AS (SELECT *, {PEER} AS peer_id FROM history),
he AS (SELECT h.message_id, h.user_id, h.peer_id, h.created_at, e.* EXCLUDE (user_id, message_id)
       FROM hp h JOIN message_events e ON h.user_id = e.user_id AND h.message_id = e.message_id)"""
ENGAGED_VIEWS = ("messages", "history", "message_events")


def engagement(name: str, on: str, prefix: str) -> str:
    def share(flag):
        return f"sum(e.{flag}::INT)::DOUBLE / nullif(count(e.message_id), 0)"
    return f""",
{name} AS (SELECT m.message_id, count(e.message_id) AS {prefix}n, count(e.reaction_time_minutes) AS {prefix}n_reacted,
  {share('message_opened')} AS {prefix}open_rate, {share('message_replied')} AS {prefix}reply_rate,
  {share('notification_dismissed')} AS {prefix}dismiss_rate, {share('muted_after_message')} AS {prefix}mute_rate,
  {share('message_reported')} AS {prefix}report_rate, median(e.reaction_time_minutes) AS {prefix}median_reaction_minutes
  FROM mp m LEFT JOIN he e ON {on} AND e.created_at < m.created_at GROUP BY m.message_id)"""


PEER_ENGAGEMENT = engagement("peer_eng", "e.user_id = m.user_id AND e.peer_id = m.peer_id", "peer_")
GLOBAL_ENGAGEMENT = engagement("global_eng", "e.peer_id = m.peer_id", "global_")
RATE_COLUMNS = ("open_rate", "reply_rate", "dismiss_rate", "mute_rate", "report_rate", "median_reaction_minutes")


def rounded_rates(prefix: str) -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {prefix}{c}" for c in RATE_COLUMNS)


# Text-derived columns of each message.
def signals(source: str = "messages") -> str:
    w, f = "w", "f"
    types = " ".join(
        f"WHEN regexp_matches({f}, {quoted(p)}) THEN '{n}'" for n, p in S.TYPE_KEYWORDS)
    mention = r"(^|[^\w@])@[a-z0-9_.-]+\b"
    return f""",
txt AS (SELECT *, {norm('message_text')} AS w, {fold('message_text')} AS f FROM {source}),
sig AS (SELECT *, CASE WHEN w <> '' THEN {scan(w, S.INJECTION_SCAN)} END AS injection_match,
  CASE WHEN w <> '' THEN {scan(w, S.CREDENTIAL_SCAN)} END AS credential_request,
  CASE WHEN w <> '' THEN {scan(w, S.PAYMENT_SCAN)} END AS payment_pressure,
  regexp_matches({f}, {quoted(S.PROMOTION)}) AS is_promotional, regexp_matches({f}, {quoted(mention)}) AS has_mention,
  regexp_matches({w}, {quoted(S.DEADLINE)}) AS has_deadline,
  CASE {types} WHEN conversation_type = 'personal' THEN 'personal' ELSE 'unknown' END AS keyword_type FROM txt)"""


ACCOUNTS = f""",
acc AS (SELECT *, {verdict()} AS brand_verdict FROM (SELECT *, {MISMATCH} AS mm FROM business_accounts) b)"""


# --- Precision detectors without look-around ----------------------------------------------
def _plain(pattern: str) -> str:
    """The pattern without its look-ahead; each is redundant or checked separately."""
    import re
    return re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "", pattern)


def attack(x: str) -> str:
    """Phrase of the injection detector over guard text ``x``."""
    parts = []
    for pattern in D.INJECTION_SHAPES:
        bare = _plain(pattern)
        match = f"nullif(regexp_extract({x}, {quoted(bare)}, 0), '')"
        if "(?!\\s+" in pattern:
            tail = (r"(\s+(?:me|us|him|her|them|everyone|anyone|the\s+group|this\s+group"
                    r"|the\s+thread|this\s+thread|the\s+chat|this\s+chat))?")
            match = f"CASE WHEN regexp_extract({x}, {quoted(bare + tail)}, 1) = '' THEN {match} END"
        parts.append(match)
    return cut(f"coalesce({', '.join(parts)})")


def unnegated(x: str, patterns) -> str:
    """First match in pattern order whose 24 characters in front hold no negation."""
    parts = []
    for pattern in patterns:
        hits, gaps = f"regexp_extract_all({x}, {quoted(pattern)})", f"string_split_regex({x}, {quoted(pattern)})"
        front = f"right(array_to_string(flatten(list_transform(range(1, i + 1), lambda j: [{gaps}[j], CASE WHEN j < i THEN {hits}[j] ELSE '' END])), ''), 24)"
        live = f"list_filter(range(1, len({hits}) + 1), lambda i: NOT regexp_matches({front}, {quoted(D.NEGATION)}))"
        parts.append(f"CASE WHEN regexp_matches({x}, {quoted(pattern)}) THEN trim({hits}[({live})[1]]) END")
    return f"coalesce({', '.join(parts)})"


def credential(x: str) -> str:
    return cut(f"coalesce({unnegated(x, D.STRONG_CREDENTIAL)}, CASE WHEN regexp_matches({x}, {quoted(D.VERIFICATION_CONTEXT)}) "
               f"THEN {unnegated(x, D.WEAK_CREDENTIAL)} END)")


def payment(x: str) -> str:
    return cut(unnegated(x, D.PAYMENT_DEMAND))


def detected(source: str = "messages") -> str:
    return f""",
gtx AS (SELECT *, {guard('message_text')} AS g FROM {source}),
det AS (SELECT message_id, {attack('g')} AS attack_phrase, {credential('g')} AS credential_phrase,
        {payment('g')} AS payment_phrase FROM gtx)"""


DETECTED = detected()

# --- Style contract -------------------------------------------------------------------------
from triagelake.functions import reasons as R  # noqa: E402


def _list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def single_sentence(x: str) -> str:
    body = f"regexp_replace({x}, '.$', '', 's')"
    body = f"regexp_replace(regexp_replace({body}, '([0-9])\\.([0-9])', '\\1_\\2', 'g'), '([0-9])\\.([0-9])', '\\1_\\2', 'g')"
    for pattern in R.NON_TERMINAL[1:]:
        body = f"regexp_replace({body}, {quoted(pattern)}, '_', 'g')"
    return (f"({x} = trim({x}) AND NOT regexp_matches({x}, '[\\r\\n]') AND regexp_matches({x}, '[.!?]$') "
            f"AND NOT regexp_matches({body}, '[.!?]'))")


def style_codes(x: str) -> str:
    """Comma-joined codes of broken style rules."""
    words = f"regexp_extract_all({fold(x)}, '[a-z0-9]+')"
    authored = f"regexp_extract_all({fold(f'regexp_replace({x}, {quoted(R.QUOTED)}, {quoted(chr(32))}, {quoted(chr(103))})')}, '[a-z0-9]+')"
    checks = (
        ("reason_length", f"length({x}) < 60 OR length({x}) > 160"),
        ("reason_sentence_count", f"NOT {single_sentence(x)}"),
        ("reason_person", f"list_has_any({authored}, {_list(R.FIRST_PERSON + R.SECOND_PERSON)})"),
        ("reason_meta_language", f"list_has_any({authored}, {_list(R.META_WORDS)})"),
        ("reason_trigger_noun", f"NOT list_has_any({words}, {_list(R.TRIGGER_NOUNS)})"),
    )
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks) + ")"


def content_words(x: str) -> str:
    stem = ("CASE WHEN ends_with(t, 'ing') AND length(t) > 5 THEN left(t, -3) WHEN ends_with(t, 'ed') AND length(t) > 4 "
            "THEN left(t, -2) WHEN ends_with(t, 'es') AND length(t) > 4 THEN left(t, -2) WHEN ends_with(t, 's') "
            "AND length(t) > 3 THEN left(t, -1) ELSE t END")
    return (f"list_distinct([{stem} for t in regexp_extract_all({fold(x)}, '[a-z0-9%]+') "
            f"if NOT list_contains({_list(R.STOPWORDS)}, t)])")


def restates(sentence: str, authored: str) -> str:
    a, b = content_words(sentence), content_words(authored)
    return f"(len({a}) = 0 OR len(list_intersect({a}, {b}))::DOUBLE / len({a}) >= 0.6)"


def percent(x: str) -> str:
    return f"concat(CAST(round_even({x} * 100, 0) AS INT), '%')"


def plural(n: str, noun: str) -> str:
    return f"concat({n}, CASE WHEN {n} = 1 THEN ' {noun}' ELSE ' {noun}s' END)"


def clamp(x: str) -> str:
    return f"round_even(least(greatest({x}, 0.55::DOUBLE), 0.95::DOUBLE), 2)"


def severity(x: str) -> str:
    return f"CASE {x} WHEN 'notify' THEN 1 WHEN 'digest' THEN 2 WHEN 'mute' THEN 3 END"
