"""Recall-grade scanners and lexical routing predicates, all JVM regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from triagelake.functions.text import truncate_phrase

# --- Fixed values: patterns, in priority order. --------------------------------------
INJECTION_SCAN = (
    r"\b(?:ignore|disregard|forget) (?:all )?(?:previous|prior|above) (?:rules|instructions)\b",
    r"\b(?:system|operator|administrator) (?:message|instruction|override|notice)\b",
    r"\b(?:always|must|should) (?:notify|digest|mute|suppress)\b",
    r"\b(?:i am|this is) (?:a )?(?:verified|trusted|official) (?:sender|account|business)\b",
)
CREDENTIAL_SCAN = (
    r"\b(?:send|share|enter|provide|confirm) (?:your )?(?:one time password|otp|pin|password|cvv)\b",
    r"\b(?:kyc|identity|account) (?:re ?verification|re ?activation|required verification)\b",
    r"\b(?:otp|pin|password|cvv) (?:is|required|needed|code)\b",
)
PAYMENT_SCAN = (
    r"\b(?:pay|payment|transfer|settle)\b.{0,60}\b(?:immediately|urgent|today|now|expires?|deadline|penalty|late fee|suspend)\b",
    r"\b(?:immediately|urgent|today|now|expires?|deadline|penalty|late fee|suspend)\b.{0,60}\b(?:pay|payment|transfer|settle)\b",
)
PROMOTION = (
    r"\b(?:sale|discount|promo(?:tion)?|offer|deal|coupon|clearance|"
    r"buy\s+one|get\s+one|free\s+(?:gift|shipping)|limited\s+time)\b|"
    r"\b\d{1,2}%\s*off\b"
)
DIRECT_MENTION = r"(?<![\w@])@[a-z0-9_.-]+\b"
DEADLINE = (
    r"\b(?:deadline|due\s+(?:today|tonight|tomorrow|by)|expires?|expiry|"
    r"last\s+(?:day|chance)|final\s+(?:notice|reminder)|urgent|asap|immediately)\b"
)
TYPE_KEYWORDS = (
    ("payment", r"\b(?:pay(?:ment)?|invoice|bill|amount\s+due|transfer|fee|balance)\b"),
    ("promotion", PROMOTION),
    ("event", r"\b(?:event|meeting|appointment|party|webinar|workshop|conference|venue|rsvp)\b"),
    ("business_update", r"\b(?:order|delivery|delivered|shipping|shipment|booking|account|status|tracking|service\s+update)\b"),
    ("greeting", r"^(?:hi|hello|hey|good\s+(?:morning|afternoon|evening)|happy\s+(?:birthday|anniversary))\b"),
    ("forward", r"\b(?:forwarded|forward\s+this|share\s+this)\b"),
    ("urgent", DEADLINE),
)
# What every match of the patterns above must hold: one string of each group.
_SECRETS, _HURRY, _PAID = ("otp", "pin", "password", "cvv"), (
    "immediately", "urgent", "today", "now", "expire", "deadline", "penalty", "late fee", "suspend"), ("pay", "transfer", "settle")
INJECTION_SCAN_NEEDLES = (
    (("ignore", "disregard", "forget"), ("rules", "instructions")), (("system", "operator", "administrator"),),
    (("notify", "digest", "mute", "suppress"),), (("verified", "trusted", "official"),),
)
CREDENTIAL_SCAN_NEEDLES = ((_SECRETS,), (("kyc", "identity", "account"),), (_SECRETS,))
PAYMENT_SCAN_NEEDLES = ((_PAID, _HURRY), (_PAID, _HURRY))
PROMOTION_NEEDLES = (("sale", "discount", "promo", "offer", "deal", "coupon", "clearance", "one", "free", "limited", "off"),)
DEADLINE_NEEDLES = (("deadline", "due", "expire", "expiry", "last", "final", "urgent", "asap", "immediately"),)
TYPE_NEEDLES = {
    "payment": (("pay", "invoice", "bill", "amount", "transfer", "fee", "balance"),), "promotion": PROMOTION_NEEDLES,
    "event": (("event", "meeting", "appointment", "party", "webinar", "workshop", "conference", "venue", "rsvp"),),
    "business_update": (("order", "deliver", "shipping", "shipment", "booking", "account", "status", "tracking", "service"),),
    "greeting": (("hi", "hello", "hey", "good", "happy"),), "forward": (("forward", "share"),), "urgent": DEADLINE_NEEDLES,
}
# --- End of fixed values. ------------------------------------------------------------


def unicode_re(pattern: str) -> str:
    """Word classes cover all scripts, as the patterns were written for."""
    return "(?U)" + pattern


def may_hold(text: Column, needles: tuple[tuple[str, ...], ...]) -> Column:
    """Whether the text has a string of each group, which costs far less than a search for a pattern."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in group]) for group in needles])


def matches(text: Column, pattern: str, needles: tuple[tuple[str, ...], ...]) -> Column:
    """``pattern`` is in the text; every match of it has a string of each group of ``needles``."""
    return may_hold(text, needles) & text.rlike(unicode_re(pattern))


def first_match(text: Column, patterns: tuple[str, ...], needles: tuple) -> Column:
    """First pattern in list order that matches; its phrase, cut to 80 characters.

    Every match of a pattern has a string of each group of its ``needles``, which are looked for first.
    """
    found = [F.when(may_hold(text, held), F.regexp_substr(text, F.lit(unicode_re(p)))) for p, held in zip(patterns, needles, strict=True)]
    return truncate_phrase(F.coalesce(*found))


def scan_injection(normalised: Column) -> Column:
    return first_match(normalised, INJECTION_SCAN, INJECTION_SCAN_NEEDLES)


def scan_credential(normalised: Column) -> Column:
    return first_match(normalised, CREDENTIAL_SCAN, CREDENTIAL_SCAN_NEEDLES)


def scan_payment(normalised: Column) -> Column:
    return first_match(normalised, PAYMENT_SCAN, PAYMENT_SCAN_NEEDLES)


def is_promotional(folded: Column) -> Column:
    return matches(folded, PROMOTION, PROMOTION_NEEDLES)


def has_direct_mention(folded: Column) -> Column:
    return matches(folded, DIRECT_MENTION, (("@",),))


def has_deadline(normalised: Column) -> Column:
    return matches(normalised, DEADLINE, DEADLINE_NEEDLES)


def keyword_type(folded: Column, conversation_type: Column) -> Column:
    """First keyword family that matches, else personal or unknown."""
    chosen = None
    for name, pattern in TYPE_KEYWORDS:
        hit = matches(folded, pattern, TYPE_NEEDLES[name])
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.when(conversation_type == "personal", "personal").otherwise("unknown")


# Fixed value: substrings that mark a dormant or prospect-only relationship.
DORMANT_MARKERS = ("old_", "opted_out", "_search", "_interest", "watchlist", "ignored_")


def is_active_relationship(why: Column) -> Column:
    dormant = F.lit(False)
    for marker in DORMANT_MARKERS:
        dormant = dormant | F.contains(why, F.lit(marker))
    return F.coalesce((F.length(why) > 0) & ~dormant, F.lit(False))
