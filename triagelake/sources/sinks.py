"""Contract output, traces, the resume store and content-keyed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from triagelake import config as C
from triagelake.operators.context import latest_per_key
from triagelake.session import cut_lineage
from triagelake.sources.contracts import ContractError
from triagelake.sources.folders import children, exists, remove, write_whole


def contract_rows(final: DataFrame) -> DataFrame:
    """The six text columns of the output contract."""
    breaks = r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029])"

    def line(c):
        # A final line break goes, every other one becomes a space.
        kept = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), breaks + r"\z", "")
        return F.regexp_replace(kept, breaks, " ")

    ids = F.when(F.size("evidence_ids") > 0, F.array_join("evidence_ids", C.EVIDENCE_SEPARATOR)).otherwise(C.NO_EVIDENCE)
    return final.select(
        "message_id", "action", "message_type", line("reason").alias("reason"),
        F.format_string("%.2f", F.col("confidence")).alias("confidence"), ids.alias("evidence_message_ids"))


def in_template_order(rows: DataFrame, template: DataFrame) -> DataFrame:
    """Rows with the template's ``position``; an id outside the template is kept with null."""
    return rows.join(template.select("message_id", "position"), "message_id", "left")


def write_contract_csv(final: DataFrame, template: DataFrame, path: str) -> None:
    """One row per message in template order under one header. Unexpected and repeated ids raise.

    The rows are worked out once and sorted globally, the header as the first of them, so the part
    files joined in name order are the contract file; nothing is gathered in one task.
    """
    text = contract_rows(final)
    same_id = Window.partitionBy("message_id")
    fault = F.when(F.col("position").isNull(), "unexpected message_id").when(F.count("*").over(same_id) > 1, "duplicate message_id")
    rows = cut_lineage(in_template_order(text, template).withColumn("fault", fault))
    wrong = rows.filter("fault IS NOT NULL").select("fault", "message_id").head(3)
    if wrong:
        raise ContractError(f"output: {[tuple(r) for r in wrong]}")
    heading = final.sparkSession.range(1).select(*[F.lit(c).alias(c) for c in text.columns], F.lit(-1).cast("long").alias("position"))
    ordered = heading.unionByName(rows.drop("fault")).orderBy("position").drop("position")
    write_whole(final.sparkSession, path, lambda fresh: ordered.write.option("quote", '"').option("escape", '"').option("emptyValue", "").csv(fresh))


def write_traces(final: DataFrame, path: str, prompt_version: str) -> None:
    """One JSON record per row with the decision, its origin and the gate's trace; the old file goes last."""
    extra = [c for c in ("outcome", "failure_reason", "rejected_reason", "fingerprint") if c in final.columns]
    trace = final.select(
        "message_id", F.lit(prompt_version).alias("prompt_version"), *extra,
        F.col("rules_fired").alias("gate_rules_fired"), "gate_trace",
        F.struct("action", "message_type", "reason", "confidence", "evidence_ids").alias("row"))
    write_whole(final.sparkSession, path, lambda fresh: trace.write.json(fresh))


# --- Resume store -------------------------------------------------------------------------

#: Batches after which the store is compacted.
COMPACT_EVERY = 8


def append_completed(rows: DataFrame, path: str, batch: int, compact_every: int = COMPACT_EVERY) -> None:
    """Append finished rows; each batch has its own number, newest wins on reading.

    When ``compact_every`` batches have gathered since the last time, the store is compacted.
    """
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("batch").parquet(path)
    if len(_batches(rows.sparkSession, path, _compacted(rows.sparkSession, path))) >= compact_every:
        compact_completed(rows.sparkSession, path)


def _compacted(spark: SparkSession, path: str) -> int | None:
    """The batch up to which the newest whole compaction goes. A torn one has no success mark and does not count."""
    done = [name for name in children(spark, f"{path}/_compacted") if exists(spark, f"{path}/_compacted/{name}/_SUCCESS")]
    return max((int(name.removeprefix("upto=")) for name in done), default=None)


def _batches(spark: SparkSession, path: str, after: int | None) -> list[int]:
    numbers = [int(name.removeprefix("batch=")) for name in children(spark, path) if name.startswith("batch=")]
    return sorted(n for n in numbers if after is None or n > after)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest compaction and the batches after it."""
    upto = _compacted(spark, path)
    later = _batches(spark, path, upto)
    if upto is None:
        return spark.read.parquet(path)
    base = spark.read.parquet(f"{path}/_compacted/upto={upto}")
    if not later:
        return base
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in later])
    return base.unionByName(rows.withColumn("batch", F.col("batch").cast("long")), allowMissingColumns=True)


def compact_completed(spark: SparkSession, path: str) -> None:
    """Rewrite the store as the newest row of each message, in ranges of ids.

    The new folder counts once Spark has marked it complete. The batches it holds stay until the next
    compaction, for readers that have listed them already; a torn folder is written again.
    """
    before = _compacted(spark, path)
    batches = _batches(spark, path, before)
    if not batches:
        return
    rows = latest_per_key(_stored(spark, path), "message_id", "batch")
    rows.repartitionByRange("message_id").sortWithinPartitions("message_id").write.mode("overwrite").parquet(f"{path}/_compacted/upto={batches[-1]}")
    if before is not None:
        for number in _batches(spark, path, None):
            if number <= before:
                remove(spark, f"{path}/batch={number}")
        for name in children(spark, f"{path}/_compacted"):
            if int(name.removeprefix("upto=")) < before:
                remove(spark, f"{path}/_compacted/{name}")


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Newest finished row per message; at most the compacted rows and the few batches after them are read."""
    return latest_per_key(_stored(spark, path), "message_id", "batch")


def split_resumable(planned: DataFrame, completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished rows that still match their inputs, and the plans left to compute."""
    keys = ["message_id", "fingerprint"]
    reused = completed.join(planned.select(*keys), keys, "left_semi")
    return reused, planned.join(completed.select(*keys), keys, "left_anti")


def latest_and_reusable(log: DataFrame, planned: DataFrame) -> DataFrame:
    """Per planned message: whether its newest record carries the same fingerprint."""
    newest = latest_per_key(log, "message_id", "seq").select("message_id", F.col("fingerprint").alias("stored"))
    return planned.join(newest, "message_id", "left").select(
        "message_id", "fingerprint", F.coalesce(F.col("stored") == F.col("fingerprint"), F.lit(False)).alias("reused"))


def first_result(log: DataFrame, key: str, sequence: str, usable) -> DataFrame:
    """First usable record per content key; later repeats never replace it."""
    values = [c for c in log.columns if c != key]
    kept = log.filter(usable)
    return kept.groupBy(key).agg(F.min_by(F.struct(*values), F.col(sequence)).alias("_r")).select(key, "_r.*")


def cached_transcripts(media: DataFrame, cache: DataFrame) -> DataFrame:
    """Voice rows with the transcript recorded for their content digest, if it succeeded."""
    usable = latest_per_key(cache.filter(F.col("status") == "ok"), "sha256", "seq").select("sha256", "transcript")
    return media.join(usable, "sha256", "left").withColumn("hit", F.col("transcript").isNotNull())


def first_rows(messages: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in file order, by the position recorded at reading."""
    return messages if limit is None else messages.orderBy("position").limit(limit)
