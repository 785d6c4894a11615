"""Vocabulary coercion and parsing of supplied decision fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from triagelake import config as C
from triagelake.functions.text import fold_ascii_words

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_vocabulary(value: Column, vocabulary: tuple[str, ...]) -> Column:
    """struct(value, tier): exact, then normalised, then longest token subset.

    ``tier`` is ``invalid`` when nothing matches and ``ambiguous`` when equally specific
    words do; ``value`` is null then.
    """
    normalised = F.regexp_replace(F.trim(F.regexp_replace(fold_ascii_words(value), r"(?U)\s+", " ")), " ", "_")
    tokens = F.regexp_extract_all(fold_ascii_words(value), F.lit("[a-z0-9]+"), 0)
    hits = []
    for word in vocabulary:
        parts = sorted(set(re.findall("[a-z0-9]+", word)))
        inside = F.size(F.array_except(F.array(*[F.lit(p) for p in parts]), tokens)) == 0
        hits.append(F.when(inside, F.struct(
            F.lit(len(parts)).alias("n_tokens"), F.lit(len(word)).alias("n_chars"), F.lit(word).alias("word"))))
    matches = F.array_compact(F.array(*hits))
    best = F.array_max(matches)
    tied = F.filter(matches, lambda m: (m["n_tokens"] == best["n_tokens"]) & (m["n_chars"] == best["n_chars"]))

    def outcome(word, tier):
        return F.struct(word.cast("string").alias("value"), F.lit(tier).alias("tier"))

    return (
        F.when(value.isNull(), outcome(F.lit(None), "invalid"))
        .when(value.isin(*vocabulary), outcome(value, "exact"))
        .when(normalised.isin(*vocabulary), outcome(normalised, "normalised"))
        .when(F.size(matches) == 0, outcome(F.lit(None), "invalid"))
        .when(F.size(tied) > 1, outcome(F.lit(None), "ambiguous"))
        .otherwise(outcome(best["word"], "token_subset"))
    )


def parse_confidence(text: Column) -> Column:
    """Finite number in [0, 1], else null."""
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(number.between(0.0, 1.0), number)


def parse_evidence_strict(text: Column) -> Column:
    """Ids as supplied; null when the list is malformed; empty for ``none``."""
    parts = F.split(text, ";", -1)
    broken = F.exists(parts, lambda p: (p == "") | p.rlike(r"(?U)[\s\x1c-\x1f]") | (p == C.NO_EVIDENCE))
    empty = F.array().cast("array<string>")
    return F.when(text == C.NO_EVIDENCE, empty).when(~broken, parts)


def parse_evidence_set(text: Column) -> Column:
    """Evaluation form: parts trimmed, a distinct sorted set; null when malformed."""
    clean = F.trim(text)
    parts = F.transform(F.split(clean, ";", -1), lambda p: F.trim(p))
    broken = F.exists(parts, lambda p: (p == "") | (p == C.NO_EVIDENCE))
    empty = F.array().cast("array<string>")
    return F.when(clean == C.NO_EVIDENCE, empty).when((clean != "") & ~broken, F.array_sort(F.array_distinct(parts)))


def ordered_evidence(text: Column) -> Column:
    """Citation order kept, blanks dropped, no error cases."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    empty = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(clean, ";", -1), lambda p: F.trim(p)), lambda p: p != "")
    return F.when((clean == "") | (clean == C.NO_EVIDENCE), empty).otherwise(parts)


def lookup(value: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def resolve_axes(risk: Column, relevance: Column, urgency: Column) -> Column:
    """Action implied by the three axes: risk vetoes, urgency notifies, else relevance."""
    unwanted = relevance.isin("low", "unwanted")
    return (
        F.when(risk.isin("unsafe", "scam_or_unsafe"), F.lit("mute"))
        .when((urgency != "none") & ~unwanted, F.lit("notify"))
        .when(unwanted, F.lit("mute"))
        .otherwise(F.lit("digest"))
    )


def media_mismatch(verdict: Column) -> Column:
    return F.coalesce(verdict.isin("no", "partial"), F.lit(False))


def boolean_word(text: Column) -> Column:
    # Of other characters only the long s casefolds to a part of these words.
    folded = F.lower(F.replace(F.trim(text), F.lit("\u017f"), F.lit("s")))
    return F.when(folded.isin("true", "1", "yes"), F.lit(True)).when(folded.isin("false", "0", "no"), F.lit(False))


def fingerprint(*columns: Column) -> Column:
    """First 16 hex digits of the SHA-256 over the canonical JSON of the inputs."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16)
