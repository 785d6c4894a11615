"""A whole run: features, decisions, failure policy, gate and outputs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from triagelake.config import DEFAULTS, Thresholds
from triagelake.functions.vocab import fingerprint
from triagelake.operators.audit import watched_run
from triagelake.operators.failure import settle
from triagelake.operators.gate import apply_gate, assert_one_directional, detect
from triagelake.operators.validation import judge, parse_decisions
from triagelake.plans.dossier import Tables, build_dossier
from triagelake.plans.router import route
from triagelake.session import cut_lineage
from triagelake.sources.files import read_decisions
from triagelake.sources.sinks import append_completed, read_completed, split_resumable, write_contract_csv, write_traces

#: Columns of the resume store.
STORED = ("message_id", "fingerprint", "action", "message_type", "reason", "confidence", "evidence_ids", "rules_fired", "gate_trace",
          "outcome", "failure_reason", "rejected_reason")


def decide(t: Tables, raw: DataFrame, thresholds: Thresholds = DEFAULTS, quiet_hours: bool = True) -> DataFrame:
    """Final decision per message from supplied raw decisions (message_id, payload)."""
    row = with_decisions(build_dossier(t, thresholds, medians=False), raw)
    settled = detect(settle(judge(row)))
    final = apply_gate(settled, thresholds, quiet_hours, keep=("outcome", "failure_reason", "rejected_reason"))
    return assert_one_directional(final)


def with_decisions(dossier: DataFrame, raw: DataFrame) -> DataFrame:
    """Feature rows with their parsed decision, null where none was supplied."""
    row = dossier.join(parse_decisions(raw), "message_id", "left")
    if "inspected_media_ids" in row.columns:
        return row
    return row.withColumn("inspected_media_ids", F.lit(None).cast("array<string>"))


def decide_by_rules(t: Tables, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Action, type and deciding rule with no supplied decision at all."""
    return route(build_dossier(t, thresholds, medians=False, lists=False), thresholds)


def plan_fingerprints(dossier: DataFrame, version: str) -> DataFrame:
    """message_id and the digest of everything its decision depends on."""
    inputs = sorted(c for c in dossier.columns if c != "message_id")
    return dossier.select("message_id", fingerprint(F.lit(version).alias("version"), *[F.col(c) for c in inputs]).alias("fingerprint"))


def run_folder(spark: SparkSession, folder: str, decisions: str, store: str, out: str, version: str, batch: int,
               totals: Observation | None = None) -> DataFrame:
    """One run from files to files; rows whose inputs have not changed since an earlier run are reused.

    Reads the dataset ``folder`` and the supplied ``decisions``, appends what it decided to ``store`` as
    ``batch`` and writes the contract file and the traces below ``out``. Returns all rows, ``resumed``
    telling the reused ones. ``totals`` gets the counts of the run from the pass that works out the rows.
    """
    t = Tables.from_folder(spark, folder)
    raw = read_decisions(spark, decisions)
    # A decision depends on its message and on what was supplied for it.
    planned = cut_lineage(plan_fingerprints(t.messages.drop("position").join(raw, "message_id", "left"), version))
    done = read_completed(spark, store) if batch else None

    def compute(left: DataFrame) -> DataFrame:
        part = replace(t, messages=t.messages.join(left.select("message_id"), "message_id", "left_semi"))
        final = decide(part, raw.join(left.select("message_id"), "message_id", "left_semi")).join(left, "message_id")
        return final.select(*STORED)

    if done is None:
        rows = compute(planned).withColumn("resumed", F.lit(False))
    else:
        rows = resume(planned, done, compute)
    rows = cut_lineage(rows if totals is None else watched_run(rows, totals))
    append_completed(rows.where("NOT resumed").drop("resumed"), store, batch)
    write_contract_csv(rows, t.messages.select("message_id", "position"), f"{out}/output.csv")
    write_traces(rows, f"{out}/traces", version)
    return rows


def resume(planned: DataFrame, completed: DataFrame, compute) -> DataFrame:
    """Reuse finished rows whose inputs did not change and compute the rest.

    ``compute`` turns the remaining plans into rows with the columns of ``completed``.
    """
    reused, left = split_resumable(planned, completed)
    fresh = compute(left)
    return reused.select(*fresh.columns, F.lit(True).alias("resumed")).unionByName(fresh.withColumn("resumed", F.lit(False)))
