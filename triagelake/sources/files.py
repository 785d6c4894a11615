"""Strict readers of the source files and the readers of decisions, traces and scores."""

from __future__ import annotations

import csv
import io
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from triagelake.config import OUTPUT_COLUMNS
from triagelake.functions.vocab import ordered_evidence, parse_confidence, parse_evidence_set
from triagelake.operators.similarity import number_in_order
from triagelake.session import cut_lineage
from triagelake.sources.contracts import ContractError, apply_schema, require_clean, require_unique
from triagelake.sources.csvlines import read_records
from triagelake.sources.digests import file_digests

# Column -> (kind, required) of every source table.
MESSAGE = {
    "message_id": ("str", True), "user_id": ("str", True), "conversation_type": ("str", True),
    "group_id": ("str", False), "business_id": ("str", False), "sender_user_id": ("str", False),
    "created_at": ("datetime", True), "message_text": ("raw", False), "media_type": ("str", False),
    "media_id": ("str", False), "forwarded_count": ("int", True),
}
TABLES = {
    "messages": MESSAGE,
    "message_history": MESSAGE,
    "users": {
        "user_id": ("str", True), "do_not_disturb_window": ("str", False), "messages_opened_30d": ("int", True),
        "messages_replied_30d": ("int", True), "notifications_dismissed_30d": ("int", True), "messages_reported_30d": ("int", True),
    },
    "groups": {
        "group_id": ("str", True), "group_name": ("str", True), "group_type": ("str", True), "member_count": ("int", True),
        "admin_count": ("int", True), "created_at": ("datetime", True), "messages_30d": ("int", True),
    },
    "group_members": {
        "group_id": ("str", True), "user_id": ("str", True), "role": ("str", True), "joined_at": ("datetime", True),
        "messages_sent_30d": ("int", True), "messages_read_30d": ("int", True), "replies_sent_30d": ("int", True),
        "notifications_dismissed_30d": ("int", True), "group_muted_by_user": ("bool", True),
    },
    "business_accounts": {
        "business_id": ("str", True), "display_name": ("str", True), "brand_name": ("str", True), "category": ("str", True),
        "verified": ("bool", True), "official_domain": ("str", False), "domain_used_by_sender": ("str", False),
        "account_age_days": ("int", True), "messages_sent_30d": ("int", True), "user_reports_30d": ("int", True),
        "domain_used_by_sender_age_days": ("int", True),
    },
    "user_business_history": {
        "user_id": ("str", True), "business_id": ("str", True), "why_user_knows_account": ("str", True),
        "last_activity_at": ("datetime", False), "allows_promotions": ("bool", True), "promotions_opted_out_at": ("datetime", False),
        "activity_count_180d": ("int", True), "messages_opened_30d": ("int", True), "messages_dismissed_30d": ("int", True),
        "messages_replied_30d": ("int", True), "last_reply_at": ("datetime", False),
    },
    "message_events": {
        "user_id": ("str", True), "message_id": ("str", True), "message_opened": ("bool", True), "message_replied": ("bool", True),
        "reaction_time_minutes": ("float", False), "notification_dismissed": ("bool", True), "muted_after_message": ("bool", True),
        "message_reported": ("bool", True),
    },
    "daily_notification_summary": {
        "user_id": ("str", True), "date": ("date", True), "notifications_sent": ("int", True), "notifications_dismissed": ("int", True),
    },
    "images": {"image_id": ("str", True), "file_path": ("str", True)},
    "voice_notes": {"voice_note_id": ("str", True), "file_path": ("str", True)},
}
UNIQUE = {
    "messages": ["message_id"], "message_events": ["user_id", "message_id"], "group_members": ["group_id", "user_id"],
    "business_accounts": ["business_id"], "user_business_history": ["user_id", "business_id"],
    "images": ["image_id"], "voice_notes": ["voice_note_id"],
}
_LABELS = {"action": ("label", True), "message_type": ("label", True), "reason": ("str", True),
           "confidence": ("str", True), "evidence_message_ids": ("str", True)}


def _names(cells: list, path: str, required: list[str]) -> list[str]:
    """Header cells as column names, or an error."""
    names = [("" if cell is None else cell).lstrip("\ufeff").strip().casefold() for cell in cells]
    if "" in names:
        raise ContractError(f"empty header cell: {path}")
    if len(set(names)) != len(names):
        raise ContractError(f"duplicate header: {path}")
    missing = [name for name in required if name not in names]
    if missing:
        raise ContractError(f"missing headers {missing}: {path}")
    return names


def read_strict_csv(spark: SparkSession, path: str, required: list[str], faults: bool = False, one_header: bool = False) -> DataFrame:
    """Text columns under trimmed lower-case names, plus file order in ``position``.

    Files of any size are read by many tasks, line breaks in quoted fields or not; the files of a folder,
    of its subfolders too, are in order of their paths. Header errors raise here, also where the files
    differ in their headers; with ``one_header`` the folder is one file in parts and only the first part
    has a header. A record with too many cells raises when it is read, or is marked in ``_surplus`` if
    ``faults``; a short record is padded with empty text.
    """
    found = read_records(spark, path, one_header)
    if not found.headings:
        raise ContractError(f"no header: {path}")
    read = [_names(next(csv.reader(io.StringIO(h, newline=""))), path, required) for h in found.headings]
    if any(names != read[0] for names in read):
        raise ContractError(f"headers differ: {path}")
    names = read[0]
    # One spare column catches a surplus cell, which a record of the right width leaves null.
    cells = [f"c{k}" for k in range(len(names) + 1)]
    options = {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE"}
    rows = found.rows.select("position", F.from_csv("record", ", ".join(f"{c} string" for c in cells), options).alias("r")).select("position", "r.*")
    surplus, first = F.col(cells[-1]).isNotNull(), F.col(cells[0])
    if not faults:
        first = F.when(surplus, F.raise_error(F.lit(f"record with more cells than headers: {path}")).cast("string")).otherwise(first)
    values = [first, *map(F.col, cells[1:-1])]
    return rows.select(*[F.coalesce(v, F.lit("")).alias(n) for v, n in zip(values, names)], "position", *[surplus.alias("_surplus")] * faults)


def read_table(spark: SparkSession, path: str, name: str, quarantine: bool = False) -> DataFrame:
    """One source table, typed; broken rows raise, or stay with ``_errors`` in quarantine mode.

    The records are cut and typed once, into a checkpoint that the contract is checked on: a filter on the errors would
    sink below the parsing and work out each field again for every error that names it.
    """
    schema = TABLES[name]
    raw = read_strict_csv(spark, path, list(schema)).select(*schema, "position")
    parsed = apply_schema(raw, schema)
    if quarantine:
        return parsed
    typed = require_clean(cut_lineage(parsed), name)
    return require_unique(typed, UNIQUE[name], name) if name in UNIQUE else typed


def read_template_ids(spark: SparkSession, path: str) -> DataFrame:
    """message_id and position of the output template."""
    rows = read_strict_csv(spark, path, ["message_id"]).select(F.trim("message_id").alias("message_id"), "position")
    return require_unique(rows, ["message_id"], path)


def _decided(spark: SparkSession, path: str, schema: dict) -> DataFrame:
    raw = read_strict_csv(spark, path, list(schema)).select(*schema, "position")
    parsed = apply_schema(raw, schema)
    number, ids = parse_confidence(F.col("confidence")), parse_evidence_set(F.col("evidence_message_ids"))
    problems = F.array_compact(F.array(
        F.when(F.col("confidence").isNotNull() & number.isNull(), F.lit("confidence: outside [0, 1]")),
        F.when(F.col("evidence_message_ids").isNotNull() & ids.isNull(), F.lit("evidence_message_ids: invalid"))))
    checked = parsed.withColumns({"_errors": F.concat("_errors", problems), "confidence": number})
    return require_unique(require_clean(checked, path), ["message_id"], path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Message columns with their labels; used by evaluation only."""
    rows = _decided(spark, path, {**MESSAGE, **_LABELS})
    if rows.isEmpty():
        raise ContractError(f"no labelled rows: {path}")
    return rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _decided(spark, path, {"message_id": ("str", True), **_LABELS})


def read_ordered_predictions(spark: SparkSession, path: str) -> DataFrame:
    """message_id and the citations in the order they were given."""
    rows = read_strict_csv(spark, path, ["message_id", "evidence_message_ids"])
    return rows.select(F.trim("message_id").alias("message_id"), ordered_evidence(F.col("evidence_message_ids")).alias("cited"))


def read_output_rows(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """A submitted file as text, for the output contract.

    What is wrong with the file itself stays in ``file_errors`` of its rows: the order of the columns
    and records with too many cells. ``line_number`` counts records in file order, the header being 1.
    ``in_parts`` reads the folder that ``write_contract_csv`` makes.
    """
    rows = read_strict_csv(spark, path, list(OUTPUT_COLUMNS), faults=True, one_header=in_parts)
    found = tuple(c for c in rows.columns if c not in ("position", "_surplus"))
    errors = F.array_compact(F.array(
        F.when(F.lit(found != OUTPUT_COLUMNS), F.lit("column order mismatch")), F.when(F.col("_surplus"), F.lit("more cells than headers"))))
    return number_in_order(rows, "position", "line_number").select(
        *OUTPUT_COLUMNS, (F.col("line_number") + 1).alias("line_number"), errors.alias("file_errors"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """message_id and the untouched JSON payload of each supplied decision."""
    lines = spark.read.text(path).withColumnRenamed("value", "payload")
    return lines.select(F.get_json_object("payload", "$.message_id").alias("message_id"), "payload")


def read_traces(spark: SparkSession, path: str, schema: str | StructType, prompt_version: str | None = None) -> DataFrame:
    """JSON traces; unreadable records are skipped."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType(fields.fields + [StructField("_corrupt_record", StringType())])
    # Parsing the lines as a column keeps the corrupt marker usable under column pruning.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", full, options).alias("t"))
    rows = parsed.filter("t._corrupt_record IS NULL").select("t.*").drop("_corrupt_record")
    return rows if prompt_version is None else rows.filter(F.col("prompt_version") == prompt_version)


def media_manifest(spark: SparkSession, images: DataFrame, voice_notes: DataFrame, root: str, within: str = "") -> DataFrame:
    """kind, media_id, file_path, file_exists, file_size_bytes and sha256 of every manifest row.

    Paths are relative to the dataset folder or to its parent and must stay inside the
    folder; anything else counts as absent, not as an error. Only what the rows name ``within`` that part
    of the folder is read, in chunks, so a file may have any size.
    """
    root = root.rstrip("/")
    rows = images.select(F.lit("image").alias("kind"), F.col("image_id").alias("media_id"), "file_path").unionByName(
        voice_notes.select(F.lit("voice").alias("kind"), F.col("voice_note_id").alias("media_id"), "file_path"))
    folder = posixpath.basename(root)
    clean = F.regexp_replace(F.regexp_replace("file_path", r"/(\./)+", "/"), r"^(\./)+", "")
    inside = ~clean.rlike(r"(^|/)\.\.(/|$)") & ~F.startswith(clean, F.lit("/"))
    relative = F.when(inside, F.regexp_replace(clean, "^" + re.escape(folder) + "/", ""))
    named = rows.withColumn("_rel", F.when(relative.startswith(f"{within}/") | F.lit(not within), relative))
    files = file_digests(named, root, "_rel").withColumnRenamed("path", "_rel")
    return named.join(files, "_rel", "left").select(
        "kind", "media_id", "file_path", F.col("sha256").isNotNull().alias("file_exists"), "file_size_bytes", "sha256")
