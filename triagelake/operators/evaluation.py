"""Scores of predictions against labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triagelake import config as C
from triagelake.functions.scores import composite, rate
from triagelake.functions.vocab import fingerprint, ordered_evidence, parse_evidence_set

# Scoring criteria and the top mark of each.
CRITERIA = ("specificity", "consistency", "register")
MAX_MARK = 3


def pair_with_gold(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every labelled row with its prediction, null where there is none.

    ``evidence_message_ids`` is text on both sides; sets are compared, so order and
    repeats do not count.
    """
    g = gold.select(
        "message_id", F.col("action").alias("gold_action"), F.col("message_type").alias("gold_type"),
        F.col("confidence").alias("gold_confidence"), parse_evidence_set(F.col("evidence_message_ids")).alias("gold_ids"),
    )
    p = predictions.select(
        "message_id", F.lit(True).alias("predicted"), F.col("action").alias("pred_action"),
        F.col("message_type").alias("pred_type"), F.col("confidence").alias("pred_confidence"),
        parse_evidence_set(F.col("evidence_message_ids")).alias("pred_ids"),
        ordered_evidence(F.col("evidence_message_ids")).alias("pred_ordered"),
    )
    return g.join(p, "message_id", "left").withColumns({
        "predicted": F.coalesce("predicted", F.lit(False)),
        "action_ok": F.coalesce(F.col("gold_action") == F.col("pred_action"), F.lit(False)),
        "type_ok": F.coalesce(F.col("gold_type") == F.col("pred_type"), F.lit(False)),
    })


def _share(count: Column, total: Column) -> Column:
    return F.coalesce(rate(count, total), F.lit(0.0))


def metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracies, dangerous cells, evidence scores and confidence error."""
    missing = ~F.col("predicted")
    totals = pairs.agg(
        F.count("*").alias("total"),
        F.count_if("action_ok").alias("action_correct"), F.count_if("type_ok").alias("type_correct"),
        F.count_if(F.col("action_ok") & F.col("type_ok")).alias("joint_correct"),
        F.count_if((F.col("gold_action") == "mute") & (F.col("pred_action") == "notify")).alias("mute_to_notify"),
        F.count_if((F.col("gold_action") == "mute") & (F.col("pred_action") == "notify") & (F.col("gold_type") == "scam")).alias("scam_to_notify"),
        F.count_if((F.col("gold_action") == "notify") & (F.col("pred_action") == "mute")).alias("notify_to_mute"),
        F.coalesce(F.sum(F.when(~missing, F.size(F.array_intersect("gold_ids", "pred_ids")))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~missing, F.size(F.array_except("pred_ids", "gold_ids")))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(missing, F.size("gold_ids")).otherwise(F.size(F.array_except("gold_ids", "pred_ids")))), F.lit(0)).alias("fn"),
        F.avg(F.coalesce(F.abs(F.col("pred_confidence") - F.col("gold_confidence")), F.lit(1.0))).alias("_mae"),
        F.count_if(missing).alias("missing_predictions"),
    )
    nothing = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    precision = F.when(nothing, 1.0).otherwise(_share(F.col("tp"), F.col("tp") + F.col("fp")))
    recall = F.when(nothing, 1.0).otherwise(_share(F.col("tp"), F.col("tp") + F.col("fn")))
    return totals.withColumns({
        "action_accuracy": _share(F.col("action_correct"), F.col("total")),
        "type_accuracy": _share(F.col("type_correct"), F.col("total")),
        "joint_accuracy": _share(F.col("joint_correct"), F.col("total")),
        "evidence_precision": precision, "evidence_recall": recall,
        "calibration_error": F.coalesce("_mae", F.lit(1.0)),
    }).withColumn(
        "evidence_f1",
        _share(2.0 * F.col("evidence_precision") * F.col("evidence_recall"), F.col("evidence_precision") + F.col("evidence_recall")),
    ).drop("_mae")


def labels(spark: SparkSession, words: tuple[str, ...], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias(name))


def _grid(spark: SparkSession, words: tuple[str, ...], left: str, right: str) -> DataFrame:
    """Every (left, right) cell of a fixed vocabulary."""
    listed = F.array(*[F.lit(w) for w in words])
    return spark.range(1).select(F.explode(listed).alias(left)).select(left, F.explode(listed).alias(right))


def confusion(pairs: DataFrame, kind: str = "action") -> DataFrame:
    """Dense confusion matrix in long form; empty cells are zero."""
    words = C.ACTIONS if kind == "action" else C.MESSAGE_TYPES
    counts = pairs.filter("predicted").groupBy(
        F.col(f"gold_{kind}").alias("gold"), F.col(f"pred_{kind}").alias("predicted")).agg(F.count("*").alias("n"))
    return _grid(pairs.sparkSession, words, "gold", "predicted").join(counts, ["gold", "predicted"], "left").fillna(0, ["n"])


def reliability(pairs: DataFrame) -> DataFrame:
    """Twenty confidence bins; rows without a prediction are left out, empty bins are not."""
    bin_no = F.least(F.floor((F.col("pred_confidence") + 1e-12) * 20), F.lit(19)).cast("int")
    counts = pairs.filter("predicted").groupBy(bin_no.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("pred_confidence").alias("mean_predicted"), F.avg("gold_confidence").alias("mean_gold"),
        F.avg(F.abs(F.col("pred_confidence") - F.col("gold_confidence"))).alias("mae"),
        F.avg(F.col("action_ok").cast("double")).alias("action_accuracy"),
    )
    bins = pairs.sparkSession.range(20).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").fillna(0, ["n"]).withColumns(
        {"lower": F.col("bin") / 20.0, "upper": (F.col("bin") + 1) / 20.0})


def prior_drift(pairs: DataFrame, kind: str = "action") -> DataFrame:
    """Share of each label in gold and in predictions, both over all labelled rows."""
    words = C.ACTIONS if kind == "action" else C.MESSAGE_TYPES
    both = F.array(F.struct(F.col(f"gold_{kind}").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")),
                   F.struct(F.col(f"pred_{kind}").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    counts = pairs.select(F.explode(both).alias("x")).select("x.*").groupBy("label").agg(F.sum("g").alias("gold_n"), F.sum("p").alias("pred_n"))
    total = pairs.agg(F.count("*").alias("total"))
    listed = total.select("total", F.explode(F.array(*[F.lit(w) for w in words])).alias("label"))
    out = listed.join(counts, "label", "left").fillna(0, ["gold_n", "pred_n"])
    return out.select(
        "label", (100.0 * _share(F.col("gold_n"), F.col("total"))).alias("gold_pct"),
        (100.0 * _share(F.col("pred_n"), F.col("total"))).alias("predicted_pct"),
    ).withColumn("delta_pp", F.col("predicted_pct") - F.col("gold_pct"))


def composite_score(scored: DataFrame, reason_quality: Column | None = None) -> DataFrame:
    """Weighted score of one metrics row; an unmeasured reason quality counts as zero."""
    quality = F.lit(None).cast("double") if reason_quality is None else reason_quality
    return scored.select(composite(
        F.col("action_accuracy"), F.col("type_accuracy"), F.col("evidence_f1"), quality, F.col("calibration_error")).alias("composite"))


def missing_and_extra(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids on one side only."""
    g, p = gold.select("message_id"), predictions.select("message_id")
    missing = g.join(p, "message_id", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(p.join(g, "message_id", "left_anti").withColumn("side", F.lit("extra")))


def slot_precision(pairs: DataFrame) -> DataFrame:
    """How often the first, second, ... citation is right."""
    cited = pairs.select("gold_ids", F.posexplode(F.coalesce("pred_ordered", F.array().cast("array<string>"))).alias("pos", "cited"))
    return cited.groupBy((F.col("pos") + 1).alias("slot")).agg(
        F.count("*").alias("attempts"), F.count_if(F.array_contains("gold_ids", F.col("cited"))).alias("hits"),
    ).withColumn("precision", rate(F.col("hits"), F.col("attempts")))


def citation_counts(pairs: DataFrame) -> DataFrame:
    """Histogram of citation counts on both sides, and rows where no cited id was right."""
    cited = F.coalesce("pred_ordered", F.array().cast("array<string>"))
    both = F.array(F.struct(F.lit("gold").alias("side"), F.size("gold_ids").alias("n_ids")),
                   F.struct(F.lit("predicted").alias("side"), F.size(cited).alias("n_ids")))
    wrong = (F.size(cited) > 0) & ~F.arrays_overlap(cited, "gold_ids")
    rows = pairs.select(F.explode(F.concat(both, F.when(wrong, F.array(
        F.struct(F.lit("all_wrong").alias("side"), F.lit(0).alias("n_ids")))).otherwise(F.slice(both, 1, 0)))).alias("x"))
    return rows.select("x.*").groupBy("side", "n_ids").agg(F.count("*").alias("n_rows"))


# --- Reason scores supplied as a table -------------------------------------------------

def parse_marks(log: DataFrame) -> DataFrame:
    """Marks of a JSON response; a missing, non-integer or out-of-range mark fails the row."""
    v = log.withColumn("_v", F.try_parse_json("response"))
    marks = {}
    for name in CRITERIA:
        kind = F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{name}", "variant"))
        value = F.try_variant_get(F.col("_v"), f"$.{name}", "int")
        marks[name] = F.when((kind == "BIGINT") & value.between(0, MAX_MARK), value)
    note_kind = F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.note", "variant"))
    out = v.withColumns(marks)
    failed = F.col(CRITERIA[0]).isNull() | F.col(CRITERIA[1]).isNull() | F.col(CRITERIA[2]).isNull()
    note = F.when(note_kind == "STRING", F.try_variant_get(F.col("_v"), "$.note", "string")).otherwise("")
    return out.withColumns({"failed": failed, "note": note}).drop("_v")


def judgement_total(*marks: Column) -> tuple[Column, Column]:
    total = sum(marks[1:], marks[0])
    return total, total / F.lit(float(MAX_MARK * len(CRITERIA)))


def score_reasons(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Marks for every row, looked up once per distinct (reason, action, type).

    The first usable record of a fingerprint wins, so a later repeat cannot move a score.
    """
    key = fingerprint(F.col("reason"), F.col("action"), F.col("message_type"))
    usable = parse_marks(log.withColumn("fingerprint", key)).filter(~F.col("failed"))
    first = usable.groupBy("fingerprint").agg(
        F.min_by(F.struct(*CRITERIA, "note"), "seq").alias("s")).select("fingerprint", "s.*")
    asked = rows.withColumn("fingerprint", key)
    distinct = asked.select("fingerprint").distinct().join(first, "fingerprint", "left")
    total, normalised = judgement_total(*[F.col(c) for c in CRITERIA])
    return asked.join(distinct, "fingerprint", "left").withColumns(
        {"failed": F.col(CRITERIA[0]).isNull(), "total": total, "normalised": normalised})


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n_rows"), F.count_if("failed").alias("failures"), *[
        F.coalesce(F.avg(F.when(~F.col("failed"), F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in CRITERIA
    ], F.coalesce(F.avg(F.when(~F.col("failed"), F.col("normalised"))), F.lit(0.0)).alias("mean_normalised"))


def total_distribution(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("failed")).groupBy("total").agg(F.count("*").alias("n_rows"))


def worst_rows(scored: DataFrame, k: int = 8) -> DataFrame:
    """Lowest totals first; ids break ties."""
    return scored.filter(~F.col("failed")).orderBy("total", "message_id").limit(k)
