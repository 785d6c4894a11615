"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.catalog.registry import Registry, joined, rounded
from triagelake.functions.vocab import fingerprint, ordered_evidence, parse_confidence, parse_evidence_set
from triagelake.operators import context as X
from triagelake.operators.evaluation import parse_marks
from triagelake.sources import sinks
from triagelake.sources.contracts import apply_schema, split_quarantine
from triagelake.sources.files import TABLES

REGISTRY = Registry()
add = REGISTRY.add

# Text fields as a loose export would hold them.
_LOOSE = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN 'x1' ELSE CAST(event_id AS {s}) END AS n,
       CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '1e2' WHEN 2 THEN 'n/a' ELSE CAST(value AS {s}) END AS r,
       CASE event_id % 6 WHEN 0 THEN 'YES' WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN 'maybe' ELSE ' True ' END AS b,
       CASE event_id % 4 WHEN 0 THEN CAST(ts AS {s}) WHEN 1 THEN '2026-07-30 22:19' WHEN 2 THEN '2023-06-13' ELSE 'soon' END AS t,
       CASE event_id % 3 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' ELSE '' END AS d, user_id AS position
FROM events"""


@add("S02_typed_fields", sql=f"""
WITH loose AS ({_LOOSE.format(s='VARCHAR')}), typed AS (
SELECT event_id, CASE WHEN regexp_full_match(trim(n), '[+-]?\\d+') THEN CAST(trim(n) AS BIGINT) END AS n,
  TRY_CAST(trim(r) AS DOUBLE) AS r,
  CASE WHEN lower(trim(b)) IN ('yes', 'true', '1') THEN true WHEN lower(trim(b)) IN ('no', 'false', '0') THEN false END AS b,
  TRY_CAST(t AS TIMESTAMP) AS t, TRY_CAST(nullif(d, '') AS DATE) AS d,
  trim(n) AS n0, r AS r0, d AS d0 FROM loose)
SELECT event_id, n, round(r, 6) AS r, b, t, d, concat_ws(',',
  CASE WHEN n0 = '' THEN 'n: blank' WHEN n IS NULL THEN 'n: not a valid int' END,
  CASE WHEN r0 IS NOT NULL AND r IS NULL THEN 'r: not a valid float' END,
  CASE WHEN b IS NULL THEN 'b: not a valid bool' END, CASE WHEN t IS NULL THEN 't: not a valid datetime' END,
  CASE WHEN d0 <> '' AND d IS NULL THEN 'd: not a valid date' END) AS errors FROM typed""")
def typed_fields(load):
    load("events").createOrReplaceTempView("driver_events")
    raw = load.spark.sql(_LOOSE.format(s="STRING").replace("FROM events", "FROM driver_events"))
    schema = {"n": ("int", True), "r": ("float", False), "b": ("bool", True), "t": ("datetime", True), "d": ("date", False)}
    parsed = apply_schema(raw, schema)
    return rounded(parsed.select("event_id", "n", "r", "b", "t", "d", joined(F.col("_errors")).alias("errors")))


def _reparse(table: str, view: str):
    """Every column as text, read back through the table's contract."""
    schema = TABLES[table]

    def run(load):
        rows = load(view)
        known = {n: k for n, k in schema.items() if n in rows.columns}
        text = rows.select(*[F.col(n).cast("string").alias(n) for n in known])
        good, bad = split_quarantine(apply_schema(text, known))
        return rounded(good.unionByName(bad.drop("_errors")))

    return run


_TABLE_QUERIES = {
    "S03_history_source": ("message_history", "history", None),
    "S04a_users": ("users", "users", None),
    "S04b_groups": ("groups", "groups", None),
    "S04c_group_members": ("group_members", "group_members", None),
    "S04d_business_accounts": ("business_accounts", "business_accounts", "trim(domain_used_by_sender) AS domain_used_by_sender"),
    "S04e_user_business_history": ("user_business_history", "user_business_history", None),
    "S04f_message_events": ("message_events", "message_events", "round(reaction_time_minutes, 6) AS reaction_time_minutes"),
    "S04g_daily_summary": ("daily_notification_summary", "daily_summary", None),
}
_PRESENT = {
    "groups": ("group_id", "group_name", "group_type", "member_count", "admin_count", "messages_30d"),
    "group_members": tuple(c for c in TABLES["group_members"] if c != "joined_at"),
    "business_accounts": tuple(c for c in TABLES["business_accounts"] if c != "messages_sent_30d"),
    "user_business_history": tuple(c for c in TABLES["user_business_history"] if c != "last_reply_at"),
}
for _name, (_table, _view, _override) in _TABLE_QUERIES.items():
    _columns = _PRESENT.get(_table, tuple(TABLES[_table]))
    _typed = {n: TABLES[_table][n][0] for n in _columns}
    _select = ", ".join(
        _override if _override and _override.endswith(f" AS {n}")
        else (f"CAST({n} AS BIGINT) AS {n}" if _typed[n] == "int" else n) for n in _columns)
    add(_name, (_view,), f"SELECT {_select} FROM {_view}")(_reparse(_table, _view))


@add("S06_labelled_source", ("gold_samples",), """SELECT message_id, lower(action) AS action, message_type,
  confidence, CASE WHEN evidence_message_ids = 'none' THEN '' ELSE array_to_string(list_sort(list_distinct(
  string_split(evidence_message_ids, ';'))), ',') END AS ids FROM gold_samples""")
def labelled_source(load):
    rows = load("gold_samples").withColumn("confidence", F.col("confidence").cast("string"))
    schema = {"message_id": ("str", True), "action": ("label", True), "message_type": ("label", True),
              "confidence": ("str", True), "evidence_message_ids": ("str", True)}
    typed, _ = split_quarantine(apply_schema(rows, schema))
    return typed.select("message_id", "action", "message_type", parse_confidence(F.col("confidence")).alias("confidence"),
                        joined(parse_evidence_set(F.col("evidence_message_ids"))).alias("ids"))


@add("S07_prediction_source", ("prediction_samples",), """SELECT message_id, action, message_type, confidence,
  count(*) OVER (PARTITION BY message_id) = 1 AS unique_id FROM prediction_samples""")
def prediction_source(load):
    rows = load("prediction_samples")
    typed, _ = split_quarantine(apply_schema(rows, {"message_id": ("str", True), "action": ("label", True), "message_type": ("label", True)}))
    counts = rows.groupBy("message_id").agg((F.count("*") == 1).alias("unique_id"))
    return typed.select("message_id", "action", "message_type", "confidence").join(counts, "message_id")


@add("S08_ordered_citations", ("prediction_samples",), """SELECT message_id, CASE WHEN evidence_message_ids = 'none' THEN ''
  ELSE replace(evidence_message_ids, ';', ',') END AS cited, CASE WHEN evidence_message_ids = 'none' THEN 0
  ELSE len(string_split(evidence_message_ids, ';')) END AS n FROM prediction_samples""")
def ordered_citations(load):
    ids = ordered_evidence(F.concat(F.lit(" "), F.col("evidence_message_ids"), F.lit(" ")))
    return load("prediction_samples").select("message_id", joined(ids).alias("cited"), F.size(ids).alias("n"))


@add("S09_raw_decisions", ("raw_decisions",), """SELECT message_id, json_extract_string(payload, '$.action') AS action,
  json_extract_string(payload, '$.confidence') AS confidence, json_extract_string(payload, '$.reason') AS reason FROM raw_decisions""")
def raw_decisions(load):
    schema = "action string, confidence string, reason string"
    return load("raw_decisions").select("message_id", F.from_json("payload", schema).alias("p")).select("message_id", "p.*")


@add("S10_traces", ("traces",), """SELECT message_id, prompt_version, outcome, rules_fired, model_calls
  FROM traces WHERE prompt_version = 'p2'""")
def traces(load):
    rows = load("traces").select(F.to_json(F.struct("message_id", "prompt_version", "outcome", "rules_fired", "model_calls")).alias("j"))
    schema = "message_id string, prompt_version string, outcome string, rules_fired string, model_calls int"
    return rows.select(F.from_json("j", schema).alias("t")).select("t.*").filter(F.col("prompt_version") == "p2")


@add("S11_contract_rows", ("decisions", "messages"), """SELECT d.message_id, m.position, action, message_type, reason,
  printf('%.2f', confidence) AS confidence, evidence_message_ids
  FROM decisions d JOIN messages m ON d.message_id = m.message_id""")
def contract_rows(load):
    rows = load("decisions").withColumn("evidence_ids", ordered_evidence(F.col("evidence_message_ids")))
    return sinks.in_template_order(sinks.contract_rows(rows), load("messages"))


@add("S12_resume_store", ("store_log",), """, newest AS (SELECT message_id, arg_max(fingerprint, seq) AS stored FROM store_log GROUP BY 1),
planned AS (SELECT message_id, arg_min(fingerprint, seq) AS fingerprint FROM store_log GROUP BY 1)
SELECT p.message_id, p.fingerprint, n.stored = p.fingerprint AS reused FROM planned p JOIN newest n ON p.message_id = n.message_id""")
def resume_store(load):
    log = load("store_log")
    planned = log.groupBy("message_id").agg(F.min_by("fingerprint", "seq").alias("fingerprint"))
    return sinks.latest_and_reusable(log, planned)


@add("S13_first_result_cache", ("score_log",), """, ok AS (SELECT *, json_extract_string(response, '$.specificity') AS mark FROM score_log
  WHERE json_type(response, '$.consistency') = 'UBIGINT' AND CAST(json_extract_string(response, '$.register') AS INT) <= 3)
SELECT reason, action, message_type, CAST(arg_min(mark, seq) AS INT) AS specificity, min(seq) AS seq FROM ok GROUP BY ALL""")
def first_result_cache(load):
    log = parse_marks(load("score_log")).withColumn("key", fingerprint(F.col("reason"), F.col("action"), F.col("message_type")))
    first = sinks.first_result(log, "key", "seq", ~F.col("failed"))
    return first.select("reason", "action", "message_type", "specificity", "seq")


@add("S13_transcript_cache", ("media",), """, v AS (SELECT media_id, sha256(file_path) AS digest, file_size_bytes,
  CASE WHEN file_exists AND file_size_bytes % 3 <> 0 THEN concat('text of ', file_path) END AS transcript FROM media WHERE kind = 'voice')
SELECT media_id, transcript, transcript IS NOT NULL AS hit FROM v""")
def transcript_cache(load):
    voice = load("media").filter("kind = 'voice'").withColumn("sha256", F.sha2("file_path", 256))
    ok = F.col("file_exists") & (F.col("file_size_bytes") % 3 != 0)
    cache = voice.select("sha256", F.when(ok, "ok").otherwise("failed").alias("status"),
                         F.concat(F.lit("text of "), "file_path").alias("transcript"), F.lit(1).alias("seq"))
    return sinks.cached_transcripts(voice, cache).select("media_id", "transcript", "hit")


@add("S14_file_order", ("messages",), """SELECT message_id, position,
  row_number() OVER (PARTITION BY user_id ORDER BY position) AS row_in_user FROM messages""")
def file_order(load):
    ranked = X.ordered_by(sinks.first_rows(load("messages"), None), ["user_id"], ["position"])
    return ranked.select("message_id", "position", F.col("row_rank").alias("row_in_user"))


@add("W07_newest_and_first", ("store_log",), """ SELECT message_id, arg_max(fingerprint, seq) AS newest, max(seq) AS newest_seq,
  arg_min(fingerprint, seq) AS first, min(seq) AS first_seq FROM store_log GROUP BY 1""")
def newest_and_first(load):
    """The newest and the first record of every key of an append-only log."""
    log = load("store_log").select("message_id", "fingerprint", "seq")
    newest = X.latest_per_key(log, "message_id", "seq").select("message_id", F.col("fingerprint").alias("newest"), F.col("seq").alias("newest_seq"))
    first = sinks.first_result(log, "message_id", "seq", F.lit(True)).select("message_id", F.col("fingerprint").alias("first"), F.col("seq").alias("first_seq"))
    return newest.join(first, "message_id")
