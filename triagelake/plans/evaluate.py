"""Evaluation run: metrics, output contract, composite score and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triagelake.operators import evaluation as E
from triagelake.sources.contracts import id_difference, output_file_summary, output_row_errors


def evaluate(gold: DataFrame, predictions: DataFrame, reason_quality: DataFrame | None = None) -> DataFrame:
    """Metrics row with its composite score; ``reason_quality`` is a one-row ``mean_normalised``."""
    scored = E.metrics(E.pair_with_gold(gold, predictions))
    if reason_quality is None:
        scored = scored.withColumn("reason_quality", F.lit(None).cast("double"))
    else:
        scored = scored.join(reason_quality.select(F.col("mean_normalised").alias("reason_quality")), F.lit(True), "left")
    w = E.composite(F.col("action_accuracy"), F.col("type_accuracy"), F.col("evidence_f1"), F.col("reason_quality"), F.col("calibration_error"))
    return scored.withColumn("composite", w)


def output_verdict(rows: DataFrame, messages: DataFrame, history: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """File summary with the number of broken rows and whether the file may be submitted."""
    broken = output_row_errors(rows, messages, history).agg(F.count_if(F.size("errors") > 0).alias("broken_rows"))
    summary = output_file_summary(rows, messages, expected_rows).join(broken, F.lit(True), "left")
    ok = F.col("row_count_ok") & (F.col("missing_ids") == 0) & (F.col("extra_ids") == 0) & (F.col("broken_rows") == 0)
    return summary.withColumn("ok", ok)


def verdict(gold: DataFrame, predictions: DataFrame, output: DataFrame, consistency: dict[str, DataFrame]) -> DataFrame:
    """One row: what may fail in an evaluation, and whether all of it passed.

    ``output`` is the row of ``output_verdict``, ``consistency`` the report on the submitted actions. A
    run passes if labelled and predicted ids agree, the file may be submitted, no two near-duplicate
    messages differ in action without a reason, and every message has an action.
    """
    ids = id_difference(gold, predictions).agg(F.count("*").alias("id_differences"))
    missing = consistency["missing"].agg(F.count("*").alias("missing_actions"))
    row = ids.join(output.select(F.col("ok").alias("output_ok")), F.lit(True), "left").join(
        consistency["summary"].select("bug_pairs"), F.lit(True), "left").join(missing, F.lit(True), "left")
    passed = (F.col("id_differences") == 0) & F.col("output_ok") & (F.col("bug_pairs") == 0) & (F.col("missing_actions") == 0)
    return row.withColumn("passed", passed)
