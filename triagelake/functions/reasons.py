"""Reason-sentence contract, formatting helpers and the restatement test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from triagelake.functions.text import fold_ascii_words

# --- Fixed values. -------------------------------------------------------------------
REASON_MIN, REASON_MAX = 60, 160
TRIGGER_NOUNS = (
    "account", "admin", "appointment", "attachment", "bill", "business", "code",
    "credential", "deadline", "delivery", "discount", "dismissal", "domain", "event",
    "fee", "forward", "greeting", "group", "history", "image", "invoice", "link",
    "meeting", "notice", "offer", "order", "otp", "password", "payment", "pin",
    "promotion", "reminder", "reply", "report", "request", "sale", "sender",
    "transcript", "voice",
)
FIRST_PERSON = ("i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves")
SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves")
META_WORDS = (
    "ai", "algorithm", "assistant", "classifier", "model", "prompt", "router", "system",
    "validator",
)
# Periods that end no sentence: decimals, a.m./p.m., abbreviations, initials.
NON_TERMINAL = (
    r"\d\.(?=\d)",
    r"(?i)\b[ap]\.m?\.?",
    r"(?i)\b(?:Rs|USD|INR|Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|No|Nos|approx|est|vs|etc"
    r"|Inc|Ltd|Pvt|Pte|Co|Apt|Ext|Ref|Fig|Ave|Rd|Blvd)\.",
    r"\b[A-Z]\.",
)
QUOTED = "[\"“][^\"”]*[\"”]"
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "for", "from",
    "had", "has", "have", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or",
    "that", "the", "their", "then", "there", "this", "to", "was", "were", "which", "who",
    "with", "message", "messages", "sender", "senders", "user", "users", "recipient", "text",
)
RESTATEMENT_OVERLAP = 0.6
QUOTE_LIMIT = 44
REPAIRABLE_CODES = ("reason_length", "reason_sentence_count")
# --- End of fixed values. ------------------------------------------------------------


def _holds_word(folded: Column, words: tuple[str, ...]) -> Column:
    """Whether one of ``words`` is a whole run of ``[a-z0-9]``."""
    return folded.rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")


def is_single_sentence(reason: Column) -> Column:
    """One sentence with terminal punctuation; non-terminal periods are masked first."""
    # A text that ends in a line break is no sentence anyway, so the last character is the terminal one.
    body = F.left(reason, F.length(reason) - 1)
    masked = body
    for pattern in NON_TERMINAL:
        masked = F.regexp_replace(masked, pattern, "_")
    # Masks add no terminal character, so a body without one needs none.
    inside = body.rlike("[.!?]")
    return (
        reason.rlike(r"[.!?]$")
        & ~F.when(inside, masked.rlike("[.!?]")).otherwise(inside)
        & ~reason.rlike(r"(?U)^[\s\x1c-\x1f]|[\s\x1c-\x1f]$|[\r\n]")
    )


def _broken_rules(reason: Column) -> tuple[tuple[str, Column], ...]:
    """Code and test of each style rule, in a fixed order."""
    authored = fold_ascii_words(F.regexp_replace(reason, QUOTED, " "))
    length = F.length(reason)
    return (
        ("reason_length", (length < REASON_MIN) | (length > REASON_MAX)),
        ("reason_sentence_count", ~is_single_sentence(reason)),
        ("reason_person", _holds_word(authored, FIRST_PERSON + SECOND_PERSON)),
        ("reason_meta_language", _holds_word(authored, META_WORDS)),
        ("reason_trigger_noun", ~_holds_word(fold_ascii_words(reason), TRIGGER_NOUNS)),
    )


def reason_issues(reason: Column) -> Column:
    """Codes of the style rules the sentence breaks, in a fixed order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in _broken_rules(reason)]))


def passes_contract(reason: Column) -> Column:
    """No style rule is broken; the first broken one ends the test."""
    return ~reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for _, broken in _broken_rules(reason)])


def percent(rate: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.bround(rate * 100, 0).cast("int").cast("string"), F.lit("%"))


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def quote_trim(phrase: Column) -> Column:
    """Collapse whitespace and cut a quoted trigger to 44 characters."""
    flat = F.trim(F.regexp_replace(phrase, r"(?U)\s+", " "))
    return F.when(
        F.length(flat) > QUOTE_LIMIT, F.concat(F.substring(flat, 1, QUOTE_LIMIT), F.lit("…"))
    ).otherwise(flat)


def quote_clean(phrase: Column) -> Column:
    """Drop quote marks that would end a quoted span."""
    return F.trim(F.regexp_replace(phrase, "[\"“”]", ""))


def humanise(token: Column) -> Column:
    return F.trim(F.replace(token, F.lit("_"), F.lit(" ")))


def _stem(word: Column) -> Column:
    """Strip one inflection when at least three letters would remain."""
    stemmed = word
    for suffix in reversed(("ing", "ed", "es", "s")):
        keep = len(suffix) + 2
        stemmed = F.when(
            F.endswith(word, F.lit(suffix)) & (F.length(word) > keep),
            F.left(word, F.length(word) - len(suffix)),
        ).otherwise(stemmed)
    return stemmed


def content_words(text: Column) -> Column:
    raw = F.regexp_extract_all(fold_ascii_words(text), F.lit("[a-z0-9%]+"), 0)
    kept = F.filter(raw, lambda w: ~w.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, _stem))


def restates(sentence: Column, authored: Column) -> Column:
    """True when the authored text already covers 60% of the sentence's content words."""
    def covered(gate: Column) -> Column:
        shared = F.size(F.array_intersect(gate, content_words(authored)))
        return (F.size(gate) == 0) | (shared / F.size(gate) >= RESTATEMENT_OVERLAP)

    # A one-element array names the words once.
    return F.get(F.transform(F.array(content_words(sentence)), covered), F.lit(0))
