"""Thresholds, weights and vocabularies used across the package."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results depend on these exact numbers and words. -----------------
ACTIONS = ("notify", "digest", "mute")
MESSAGE_TYPES = (
    "personal", "urgent", "event", "payment", "business_update", "promotion",
    "greeting", "forward", "spam", "scam", "unknown",
)
# Axis spellings accepted on input, and the internal value each one maps to.
RISK_AXES = {
    "clean": "clean", "suspect": "suspect", "suspicious": "suspect",
    "unsafe": "unsafe", "scam_or_unsafe": "unsafe",
}
RELEVANCE_AXES = {
    "high": "high", "wanted": "high", "relevant": "high",
    "medium": "medium", "neutral": "medium",
    "low": "low", "unwanted": "low",
}
URGENCY_AXES = ("immediate", "today", "none")
NO_EVIDENCE = "none"
EVIDENCE_SEPARATOR = ";"
OUTPUT_COLUMNS = (
    "message_id", "action", "message_type", "reason", "confidence", "evidence_message_ids",
)
MAX_EVIDENCE_IDS = 2

# Confidence range, penalties and the ceiling on a blocked row.
CONF_FLOOR, CONF_CEIL = 0.55, 0.95
MEDIA_MISMATCH_PENALTY = 0.05
FIRST_CONTACT_PENALTY = 0.05
HARD_BLOCK_CONFIDENCE = 0.85

# Evidence ranking.
RECENCY_HALF_LIFE_DAYS = 30.0
EVIDENCE_TOP_K = 6
EVIDENCE_MIN_SCORE = 0.12
W_SAME_PEER, W_LEXICAL, W_SAME_GROUP, W_EVENT, W_RECENCY = 0.35, 0.25, 0.15, 0.15, 0.10
EVENT_RELEVANCE = {
    "reported": 1.0, "muted_after": 0.9, "replied": 0.7, "dismissed": 0.6, "opened": 0.3,
}
NEAR_DUPLICATE_TOP_K = 3
NEAR_DUPLICATE_MIN_JACCARD = 0.45
CLUSTER_MIN_JACCARD = 0.85          # strict: similarity must exceed it
BURST_WINDOW_HOURS = 24

# Token pricing multipliers for cached prompt tokens.
CACHE_READ_MULTIPLIER, CACHE_WRITE_MULTIPLIER = 0.10, 1.25

# Composite score weights.
COMPOSITE_WEIGHTS = {
    "action": 0.35, "type": 0.25, "evidence": 0.15, "reason": 0.15, "calibration": 0.10,
}
# --- End of fixed values. ------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """The tunable cut-offs of the brand verdict and the dismiss rule."""

    brand_min_age_days: int = 365
    brand_min_domain_age_days: int = 180
    brand_max_reports: int = 29
    dismiss_mute_threshold: float = 0.5
    min_peer_history: int = 1


DEFAULTS = Thresholds()

# One-at-a-time sweep grid (fixed values).
SWEEP_VALUES = {
    "brand_min_age_days": (180, 270, 365, 450, 540),
    "brand_max_reports": (10, 20, 29, 40, 50),
    "dismiss_mute_threshold": (0.3, 0.4, 0.5, 0.6, 0.7),
    "min_peer_history": (1, 2, 3, 4, 5),
}


@dataclass(frozen=True)
class Scale:
    """Sizes that bound one task's work; they never change a result."""

    # Rows of one side of a (user, block) cell in the pairwise ranking kernel.
    pair_block_rows: int = 1024
    # Seconds per time slice of a two-level running total.
    slice_seconds: int = 3600
    # Rows of one key in a slice above which the slice is cut again.
    slice_rows: int = 200_000
    # Groups above this many rows leave the windowed median for the value descent.
    median_window_rows: int = 2048
    # Members of one similarity bucket compared in one cell.
    similarity_block_rows: int = 512


SCALE = Scale()
