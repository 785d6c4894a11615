"""Incremental and streaming runs."""

from __future__ import annotations

import os
import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, functions as F

from triagelake.catalog import sqltext as q
from triagelake.catalog.joins import BURST, DOSSIER_VIEWS, tables
from triagelake.catalog.outcomes import ROUTED, ROUTER_VIEWS, RUN_SQL
from triagelake.catalog.registry import Registry, rounded
from triagelake.functions.vocab import parse_evidence_set
from triagelake.operators.audit import watched_traces
from triagelake.operators.engagement import with_events
from triagelake.operators.similarity import number_in_order
from triagelake.plans.dossier import enriched_history
from triagelake.plans.run import run_folder
from triagelake.session import at_once, shared_dir
from triagelake.sources.bucketed import Reactions
from triagelake.sources.files import (
    TABLES, media_manifest, read_decisions, read_ordered_predictions, read_output_rows, read_predictions, read_strict_csv, read_traces)
from triagelake.sources.sinks import first_rows
from triagelake.streaming import live

REGISTRY = Registry()
add = REGISTRY.add


def _scratch(load, name: str) -> str:
    return os.path.join(shared_dir(load.spark), f"{name}-{uuid.uuid4().hex}")


#: Table of the dataset folder -> view it is written from, and values of columns the view lacks.
_FOLDER = {
    "messages": ("messages", {}), "message_history": ("history", {}), "users": ("users", {}),
    "groups": ("groups", {"created_at": "2024-01-01 00:00"}), "group_members": ("group_members", {"joined_at": "2024-01-01 00:00"}),
    "business_accounts": ("business_accounts", {"messages_sent_30d": "0"}), "user_business_history": ("user_business_history", {"last_reply_at": ""}),
    "message_events": ("message_events", {}), "daily_notification_summary": ("daily_summary", {}),
}


def _write_csv(rows, path: str) -> None:
    text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    text.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_folder(load, folder: str) -> None:
    """The derived tables as the CSV files of a dataset folder, in file order where there is one; the files are written side by side."""
    steps = []
    for table, (view, fixed) in _FOLDER.items():
        rows = load(view).withColumns({c: F.lit(v) for c, v in fixed.items()})
        rows = rows.orderBy("position") if "position" in rows.columns else rows
        steps.append(partial(_write_csv, rows.select(*TABLES[table]), f"{folder}/{table}.csv"))
    for table, kind, key in (("images", "image", "image_id"), ("voice_notes", "voice", "voice_note_id")):
        rows = load("media").where(F.col("kind") == kind).select(F.col("media_id").alias(key), "file_path")
        steps.append(partial(_write_csv, rows, f"{folder}/{table}.csv"))
    at_once(steps)


@add("S05_file_digests", ("media",), """, f AS (SELECT kind, file_size_bytes % 8 AS slot, string_agg(file_path || chr(10), '' ORDER BY media_id, file_path) AS body
  FROM media WHERE file_size_bytes IS NOT NULL GROUP BY ALL)
SELECT kind, CAST(slot AS VARCHAR) AS media_id, true AS file_exists, strlen(body) AS file_size_bytes, sha256(body) AS sha256 FROM f""")
def file_digests(load):
    """The digests of files that hold the paths of the media table, one file for each kind and slot."""
    folder, spark = _scratch(load, "files"), load.spark
    rows = load("media").where("file_size_bytes IS NOT NULL").select("kind", (F.col("file_size_bytes") % 8).alias("slot"), "media_id", "file_path")
    (rows.repartition("kind", "slot").sortWithinPartitions("kind", "slot", "media_id", "file_path").drop("media_id")
     .write.partitionBy("kind", "slot").text(folder))
    named = spark.read.format("binaryFile").load(folder).select(
        "kind", F.col("slot").cast("string").alias("slot"), F.regexp_extract("path", "(kind=.*)$", 1).alias("file_path"))
    images, voices = (named.where(F.col("kind") == kind).withColumnRenamed("slot", key) for kind, key in (("image", "image_id"), ("voice", "voice_note_id")))
    return media_manifest(spark, images, voices, folder).drop("file_path")


@add("J02_bucketed_events", q.ENGAGED_VIEWS, """ SELECT h.message_id, h.user_id, e.message_id IS NOT NULL AS has_event, coalesce(e.message_opened, false) AS opened,
  coalesce(e.muted_after_message, false) AS muted_after, round(e.reaction_time_minutes, 6) AS reaction_time_minutes
  FROM history h LEFT JOIN message_events e ON h.user_id = e.user_id AND h.message_id = e.message_id""")
def bucketed_events(load):
    """History with its reactions from stored buckets, to which a second batch is added; the join exchanges nothing."""
    later = F.pmod(F.xxhash64("message_id"), F.lit(3)) == 0
    history, events = load("history"), load("message_events")
    stored = Reactions.store(history.where(~later), events.where(~later), _scratch(load, "reactions"))
    stored.append(history.where(later), events.where(later))
    return rounded(with_events(*stored.tables(load.spark)).select("message_id", "user_id", "has_event", "opened", "muted_after", "reaction_time_minutes"))


def _decision_lines(load):
    """The supplied payloads with their message's id, one JSON line each."""
    named = F.concat(F.lit('{"message_id":"'), "message_id", F.lit('",'), F.expr("substring(payload, 2)"))
    return load("raw_decisions").select("message_id", named.alias("value"))


@add("R17_incremental_run", (*DOSSIER_VIEWS, "raw_decisions"), RUN_SQL.rpartition("SELECT g.message_id")[0] + """SELECT g.message_id, g.action, g.message_type, g.reason,
  printf('%.2f', g.confidence) AS confidence, CASE WHEN t.evidence = '' THEN 'none' ELSE replace(t.evidence, ',', ';') END AS evidence_message_ids,
  1 + row_number() OVER (ORDER BY m.position) AS line_number, m.forwarded_count > 0 AND m.forwarded_count % 3 <> 0 AS resumed
  FROM gated g JOIN settled t ON g.message_id = t.message_id JOIN messages m ON g.message_id = m.message_id""")
def incremental(load):
    """Two runs from files to files: the second one reuses the rows whose inputs are the same, and writes all."""
    folder, spark = _scratch(load, "dataset"), load.spark
    write_folder(load, folder)
    lines = _decision_lines(load)
    forwarded = load("messages").select("message_id", "forwarded_count")
    # In the earlier run some rows had no decision yet, and some another one.
    early = lines.join(forwarded, "message_id").where("forwarded_count > 0").select(
        F.when(F.col("forwarded_count") % 3 == 0, F.concat(F.lit('{"message_id":"'), "message_id", F.lit('"}'))).otherwise(F.col("value")).alias("value"))
    early.write.text(f"{folder}/early.jsonl")
    lines.select("value").write.text(f"{folder}/decisions.jsonl")
    run_folder(spark, folder, f"{folder}/early.jsonl", f"{folder}/store", f"{folder}/first", "v1", 0)
    totals = Observation()
    rows = run_folder(spark, folder, f"{folder}/decisions.jsonl", f"{folder}/store", f"{folder}/second", "v1", 1, totals)
    reused = rows.where("resumed").count()
    if totals.get["resumed"] != reused:
        raise AssertionError(f"observed {totals.get}, reused {reused}")
    written = read_output_rows(spark, f"{folder}/second/output.csv", in_parts=True).drop("file_errors")
    return written.join(rows.select("message_id", "resumed"), "message_id")


@add("S01_strict_csv", ("messages",), """ SELECT message_id, message_text, coalesce(sender_user_id, '') AS sender_user_id,
  row_number() OVER (ORDER BY position) AS line FROM messages""")
def strict_csv(load):
    """Messages in several files, read back as text in file order."""
    path = f"{_scratch(load, 'csv')}/messages.csv"
    _write_csv(load("messages").repartitionByRange(6, "position").sortWithinPartitions("position").select(*TABLES["messages"]), path)
    rows = read_strict_csv(load.spark, path, list(TABLES["messages"]))
    return number_in_order(rows.select("message_id", "message_text", "sender_user_id", "position"), "position", "line").drop("position")


@add("S09_decision_lines", ("raw_decisions",), """ SELECT message_id, json_extract_string(payload, '$.action') AS action,
  json_extract_string(payload, '$.confidence') AS confidence FROM raw_decisions""")
def decision_lines(load):
    """Supplied decisions read from their JSON lines."""
    path = _scratch(load, "decisions")
    _decision_lines(load).select("value").write.text(path)
    rows = read_decisions(load.spark, path)
    return rows.select("message_id", F.get_json_object("payload", "$.action").alias("action"), F.get_json_object("payload", "$.confidence").alias("confidence"))


@add("S10_trace_lines", ("traces",), """ SELECT message_id, prompt_version, outcome, rules_fired, model_calls
  FROM traces WHERE prompt_version = 'p2'""")
def trace_lines(load):
    """Traces written as JSON lines among broken ones and read back for one version."""
    path = _scratch(load, "traces")
    fields = ("message_id", "prompt_version", "outcome", "rules_fired", "model_calls")
    whole = load("traces").select(F.to_json(F.struct(*fields)).alias("value"))
    whole.unionByName(whole.select(F.substring("value", 1, 9).alias("value"))).write.text(path)
    return read_traces(load.spark, path, "message_id string, prompt_version string, outcome string, rules_fired string, model_calls int", "p2")


@add("S07_prediction_files", ("prediction_samples",), """ SELECT message_id, action, message_type, confidence,
  CASE WHEN evidence_message_ids = 'none' THEN '' ELSE array_to_string(list_sort(list_distinct(string_split(evidence_message_ids, ';'))), ',') END AS ids,
  CASE WHEN evidence_message_ids = 'none' THEN '' ELSE replace(evidence_message_ids, ';', ',') END AS cited FROM prediction_samples""")
def prediction_files(load):
    """Predictions written as CSV and read by both readers: as sets, and in the order they were given."""
    path = _scratch(load, "predictions")
    _write_csv(load("prediction_samples").withColumn("reason", F.lit("The sender posted a notice.")), path)
    rows = read_predictions(load.spark, path)
    sets = F.array_join(parse_evidence_set(F.col("evidence_message_ids")), ",")
    cited = read_ordered_predictions(load.spark, path).select("message_id", F.array_join("cited", ",").alias("cited"))
    return rows.select("message_id", "action", "message_type", "confidence", sets.alias("ids")).join(cited, "message_id")


@add("S14_first_rows", ("messages",), """ SELECT message_id, position FROM messages WHERE position < (SELECT min(position) + 700 FROM messages)""")
def first_of_file(load):
    """The selection of the first rows in file order."""
    return first_rows(load("messages"), 700).select("message_id", "position")


#: Messages of a file of the stream, so that the batches of a long backlog are not many small ones.
_FILE_ROWS = 100_000


def _stream_of_messages(load):
    """The messages as a stream: the domain rows are written once and read file by file."""
    path = _scratch(load, "messages")
    rows = load("messages")
    rows.coalesce(max(load.spark.sparkContext.defaultParallelism, -(-rows.count() // _FILE_ROWS))).write.parquet(path)
    return load.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _snapshot(load, name: str, rows: DataFrame) -> DataFrame:
    path = _scratch(load, name)
    rows.write.parquet(path)
    return load.spark.read.parquet(path)


@add("T01_streamed_router", ROUTER_VIEWS, ROUTED.replace("AND e.created_at < m.created_at", "") + " SELECT message_id, action, message_type, rule FROM routed")
def streamed_router(load):
    """Streamed messages routed against a finished history snapshot."""
    t = tables(load)
    from triagelake.functions.scores import rate
    peers = enriched_history(t).filter("has_event AND peer_id IS NOT NULL").groupBy("user_id", "peer_id").agg(
        F.count("*").alias("peer_n"), rate(F.count_if("dismissed"), F.count("*")).alias("peer_dismiss_rate"))
    # Written once: every batch of the stream joins the finished snapshots and works none of them out again.
    known = t.user_business_history.select("user_id", "business_id", "promotions_opted_out_at")
    accounts, known, peers = (_snapshot(load, name, rows) for name, rows in (("accounts", t.business_accounts), ("known", known), ("peers", peers)))
    features = live.stream_features(_stream_of_messages(load), accounts, known, peers)
    store = _scratch(load, "routed")
    live.route_stream(features, store, _scratch(load, "state")).awaitTermination()
    return live.read_routed(load.spark, store).select("message_id", "action", "message_type", "rule")


@add("T02_streamed_bursts", ("messages",), """, hours AS (SELECT CASE WHEN conversation_type = 'business' THEN business_id ELSE sender_user_id END AS peer_id,
  user_id, date_trunc('hour', created_at) AS hour FROM messages)
SELECT user_id, peer_id, hour - to_hours(CAST(k AS INT)) AS window_start, hour - to_hours(CAST(k AS INT)) + INTERVAL 24 HOUR AS window_end, count(*) AS n
  FROM hours, range(0, 24) AS r(k) WHERE peer_id IS NOT NULL GROUP BY ALL""")
def streamed_bursts(load):
    """Hourly sliding 24-hour counts per recipient and sender."""
    out = _scratch(load, "bursts")
    counts = live.burst_stream(_stream_of_messages(load), live.lateness(load("messages")))
    live.store_bursts(counts, out, _scratch(load, "state")).awaitTermination()
    return live.read_bursts(load.spark, out)


@add("T02_exact_bursts", q.ENGAGED_VIEWS, q.ENGAGED + BURST + " SELECT * FROM burst")
def exact_bursts(load):
    """The exact trailing 24 hours of every message, from a stream of messages and history in files."""
    t = tables(load)
    kinds = [(t.messages, True), (t.history, False)]
    rows = reduce(DataFrame.unionByName, [
        live.burst_rows(df, asked).repartitionByRange(4, "created_at", "message_id") for df, asked in kinds])
    path, store = _scratch(load, "rows"), _scratch(load, "exact")
    rows.write.parquet(path)
    stream = load.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)
    live.store_exact_bursts(live.exact_bursts(stream, live.lateness(rows), buckets=live.buckets_for(rows)), store, _scratch(load, "exact-state")).awaitTermination()
    found = live.read_exact_bursts(load.spark, store)
    return t.messages.select("message_id").join(found, "message_id", "left").fillna(0, ["sender_burst_24h"])


@add("A16_observed_totals", ("traces",), """ SELECT count(*) AS n_traces, count_if(rules_fired <> '') AS fired_rows, count_if(pre_action <> post_action) AS changed_rows,
  count_if(hard_blocked) AS hard_blocked_rows FROM traces""")
def observed_totals(load):
    """The gate's totals from the job that writes the traces."""
    totals = Observation()
    rules = F.filter(F.split("rules_fired", ";"), lambda r: r != "")
    traces = load("traces").withColumns({"rules": rules, "action_changed": F.lit(False)})
    watched_traces(traces, totals).write.parquet(_scratch(load, "traces"))
    found = totals.get
    return load.spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} long" for name in found))
