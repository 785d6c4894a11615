"""Integrity verdict of business accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triagelake.config import DEFAULTS, Thresholds
from triagelake.functions.text import domain_mismatch


def brand_conditions(t: Thresholds = DEFAULTS) -> dict:
    """The five checks, in the order their tokens are reported."""
    return {
        "domain_mismatch": F.coalesce(F.col("domain_mismatch"), F.lit(False)),
        "unverified": ~F.col("verified"),
        "account_new": F.col("account_age_days") < t.brand_min_age_days,
        "sender_domain_new": F.col("domain_used_by_sender_age_days") < t.brand_min_domain_age_days,
        "reported_by_users": F.col("user_reports_30d") > t.brand_max_reports,
    }


def brand_verdict(t: Thresholds = DEFAULTS):
    checks = brand_conditions(t)
    every = F.lit(True)
    for check in checks.values():
        every = every & check
    doubtful = (
        checks["domain_mismatch"]
        | (F.col("domain_mismatch").isNull() & checks["unverified"])
        | checks["reported_by_users"]
    )
    return F.when(every, "impersonation").when(doubtful, "suspect").otherwise("clean")


def brand_integrity(accounts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Accounts with ``domain_mismatch``, ``brand_verdict`` and ``verdict_basis``."""
    checked = accounts.withColumn(
        "domain_mismatch", domain_mismatch(F.col("official_domain"), F.col("domain_used_by_sender"))
    )
    tokens = [F.when(F.col("official_domain").isNull(), F.lit("official_domain_absent"))]
    tokens += [F.when(check, F.lit(name)) for name, check in brand_conditions(t).items()]
    return checked.withColumn("brand_verdict", brand_verdict(t)).withColumn(
        "verdict_basis", F.array_compact(F.array(*tokens))
    )
