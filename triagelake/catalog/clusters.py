"""Near-duplicate links, clusters and the consistency audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.catalog import sqltext as q
from triagelake.catalog.joins import tables
from triagelake.catalog.registry import Registry, joined, plain_counts, rounded
from triagelake.operators import divergence as V
from triagelake.operators.similarity import (
    connected_components, extend_components, first_near_duplicate, near_duplicate_clusters, near_duplicate_links)
from triagelake.plans.consistency import clustered_members, consistency_report, dossier_features, message_clusters
from triagelake.plans.dossier import build_dossier
from triagelake.plans.evaluate import output_verdict, verdict
from triagelake.session import cut_lineage

REGISTRY = Registry()
add = REGISTRY.add

def pair_ctes(reps: str) -> str:
    """Pairs of distinct texts above the threshold, by counting shared trigrams."""
    return f"""
tok AS (SELECT rep, len(g) AS n, unnest(list_transform(g, lambda z: hash(z))) AS t FROM (SELECT rep, {q.grams('w')} AS g FROM {reps}) x),
shared AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM tok a JOIN tok b
  ON a.t = b.t AND a.rep < b.rep AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
half AS (SELECT x, y, c::DOUBLE / (na + nb - c) AS jac FROM shared WHERE c::DOUBLE / (na + nb - c) > 0.85),
hit AS (SELECT x, y, jac FROM half UNION ALL SELECT y, x, jac FROM half)"""


# Distinct texts, pairs above the threshold by brute force, and their components.
PAIRS = f""",
rows0 AS (SELECT message_id, position, {q.norm('message_text')} AS w FROM messages),
reps AS (SELECT w, min(message_id) AS rep FROM rows0 WHERE length(w) >= 3 GROUP BY w),{pair_ctes('reps')}"""
COMPONENTS = PAIRS.replace(",\nrows0", "rows0", 1) + """,
walk(n, r) AS (SELECT rep, rep FROM reps UNION SELECT h.y, walk.r FROM walk JOIN hit h ON h.x = walk.n),
comp AS (SELECT n, min(r) AS root FROM walk GROUP BY n),
placed AS (SELECT r.message_id, r.position, c.root FROM rows0 r JOIN reps p ON r.w = p.w JOIN comp c ON c.n = p.rep),
sized AS (SELECT root, arg_min(message_id, position) AS leader FROM placed GROUP BY root HAVING count(*) > 1),
numbered AS (SELECT root, row_number() OVER (ORDER BY leader) AS cluster_number FROM sized),
clu AS (SELECT p.message_id, p.root, n.cluster_number FROM placed p JOIN numbered n ON p.root = n.root)"""


def _texts(load):
    return load("messages").select(F.col("message_id").alias("id"), F.col("message_text").alias("text"), "position")


@add("J14_near_duplicate_join", ("messages",), PAIRS + """, near AS (SELECT x AS rep, min({'o': y, 'j': jac}) AS m FROM hit GROUP BY x),
best AS (SELECT r.message_id, CASE WHEN p.rep < r.message_id AND (n.m.o IS NULL OR p.rep < n.m.o) THEN {'o': p.rep, 'j': 1.0::DOUBLE}
  WHEN n.m.o < r.message_id THEN {'o': n.m.o, 'j': n.m.j} END AS f FROM rows0 r JOIN reps p ON r.w = p.w LEFT JOIN near n ON n.rep = p.rep)
SELECT message_id, f.o AS first_id, round(f.j, 6) AS jaccard FROM best WHERE f IS NOT NULL""")
def near_duplicate_join(load):
    """First earlier message each message nearly repeats."""
    links, members = near_duplicate_links(_texts(load).select("id", "text"))
    return rounded(first_near_duplicate(links, members).withColumnRenamed("id", "message_id"))


@add("J14_document_copies", sql=f"""WITH d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, {q.norm('text')} AS w FROM documents),
reps AS (SELECT w, min(id) AS rep FROM d WHERE length(w) >= 3 GROUP BY w),{pair_ctes('reps')},
near AS (SELECT x AS rep, min(y) AS o FROM hit GROUP BY x),
best AS (SELECT d.id, least(CASE WHEN p.rep < d.id THEN p.rep END, CASE WHEN n.o < d.id THEN n.o END) AS first_id FROM d JOIN reps p ON d.w = p.w LEFT JOIN near n ON n.rep = p.rep)
SELECT id, first_id FROM best WHERE first_id IS NOT NULL""")
def document_copies(load):
    """The same over whole documents."""
    texts = load("documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "text")
    links, members = near_duplicate_links(texts)
    return first_near_duplicate(links, members).select("id", "first_id")


def _recursive(views, body):
    """The component walk needs a recursive WITH list."""
    from triagelake.sources.driver_views import check_sql
    sql = check_sql(views, ", " + COMPONENTS + body)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _add_recursive(name, views, body):
    def register(fn):
        add(name)(fn)
        REGISTRY.checks[name] = plain_counts(_recursive(views, body))
        return fn
    return register


@_add_recursive("X03_connected_components", ("messages",), " SELECT message_id, root, cluster_number FROM clu")
def components(load):
    return near_duplicate_clusters(_texts(load)).select(F.col("id").alias("message_id"), "root", "cluster_number")


_SIMPLE = ("conversation_type", "media_type", "group_id", "forwarded_count")
_MEMBERS = f""", mem AS (SELECT c.cluster_number, c.message_id, d.action, m.conversation_type, m.media_type, m.group_id, m.forwarded_count
  FROM clu c JOIN decisions d ON c.message_id = d.message_id JOIN messages m ON c.message_id = m.message_id),
dv AS (SELECT a.cluster_number, a.message_id AS id, a.action, b.message_id AS other_id, b.action AS other_action,
  {', '.join(f'a.{c} IS DISTINCT FROM b.{c} AS d_{c}' for c in _SIMPLE)} FROM mem a JOIN mem b ON a.cluster_number = b.cluster_number AND a.action <> b.action)"""


def _members(load):
    features = load("messages").select("message_id", V.feature_map(list(_SIMPLE)).alias("features"))
    return clustered_members(load("messages"), load("decisions"), features)


@_add_recursive("J17_divergent_pairs", ("messages", "decisions"), _MEMBERS + f""", n AS (SELECT cluster_number, count(*) AS n_members FROM mem GROUP BY 1)
SELECT n.cluster_number, n_members, count_if(coalesce(id < other_id, false)) AS divergent_pairs,
  count_if(coalesce(id < other_id AND NOT ({' OR '.join('d_' + c for c in _SIMPLE)}), false)) AS unexplained_pairs
FROM n LEFT JOIN dv ON n.cluster_number = dv.cluster_number GROUP BY ALL""")
def divergent_pairs(load):
    return V.cluster_divergence(_members(load))


@_add_recursive("X05_feature_differences", ("messages", "decisions"), _MEMBERS + " , long AS (" + " UNION ALL ".join(
    f"SELECT cluster_number, '{c}' AS feature, count_if(d_{c}) // 2 AS differing_pairs FROM dv GROUP BY 1" for c in _SIMPLE) + ") SELECT cluster_number, feature, CAST(differing_pairs AS BIGINT) AS differing_pairs FROM long")
def feature_differences(load):
    return V.feature_divergence(_members(load))


@_add_recursive("R13_divergence_witnesses", ("messages", "decisions"), _MEMBERS + """, fw AS (SELECT *, row_number() OVER (PARTITION BY id, other_action ORDER BY other_id) AS rn FROM dv)
SELECT cluster_number, id, action, other_id, other_action, concat_ws(',', CASE WHEN d_conversation_type THEN 'conversation_type' END, CASE WHEN d_forwarded_count THEN 'forwarded_count' END,
  CASE WHEN d_group_id THEN 'group_id' END, CASE WHEN d_media_type THEN 'media_type' END) AS differing_features FROM fw WHERE rn = 1""")
def witnesses(load):
    return V.divergence_witnesses(_members(load)).withColumn("differing_features", joined("differing_features")).drop("is_bug")


@_add_recursive("R15_verdict", ("messages", "history", "decisions", "gold_samples", "prediction_samples"), _MEMBERS + f""", bugs AS (
  SELECT count(*) AS n FROM dv WHERE id < other_id AND NOT ({' OR '.join('d_' + c for c in _SIMPLE)})),
ids AS (SELECT count(*) AS n FROM gold_samples g FULL JOIN prediction_samples p ON g.message_id = p.message_id WHERE g.message_id IS NULL OR p.message_id IS NULL)
SELECT 'clean' AS kind, 0 AS id_differences, true AS output_ok, 0 AS bug_pairs, 0 AS missing_actions, true AS passed
UNION ALL SELECT 'broken', ids.n, false, bugs.n, (SELECT count(*) FROM messages WHERE forwarded_count > 2), false FROM ids, bugs""")
def evaluation_verdicts(load):
    """The verdict on a clean submission and on a broken one."""
    messages, history, gold = load("messages"), load("history"), load("gold_samples")
    features = messages.select("message_id", V.feature_map(list(_SIMPLE)).alias("features"))
    good = messages.select("message_id", F.lit("digest").alias("action"), F.lit("payment").alias("message_type"), F.lit("The sender posted a notice.").alias("reason"),
                           F.lit("0.75").alias("confidence"), F.lit("none").alias("evidence_message_ids"), (F.col("position") + 2).alias("line_number"))
    clusters = message_clusters(messages)
    clean = verdict(gold, gold, output_verdict(good, messages, history), consistency_report(messages, good, features, clusters=clusters))
    acted = load("decisions").join(messages.where("forwarded_count <= 2").select("message_id"), "message_id", "left_semi")
    all_ = consistency_report(messages, load("decisions"), features, clusters=clusters)
    some = messages.select("message_id").join(acted.select("message_id"), "message_id", "left_anti")
    broken = verdict(gold, load("prediction_samples"), output_verdict(good.where(F.col("line_number") % 2 == 0), messages, history),
                     {**all_, "missing": some})
    return clean.withColumn("kind", F.lit("clean")).unionByName(broken.withColumn("kind", F.lit("broken")))


@_add_recursive("X03_incremental_clusters", ("messages",), """, paired AS (SELECT DISTINCT x AS rep FROM hit)
SELECT c.n AS message_id, c.root FROM comp c JOIN paired p ON c.n = p.rep""")
def incremental_clusters(load):
    """Components of near-duplicate texts from a store that three batches of links extend."""
    links, _ = near_duplicate_links(_texts(load).select("id", "text"))
    batch = F.pmod(F.xxhash64("id", "other"), F.lit(3))
    stored = connected_components(links.filter(batch == 0))
    for number in (1, 2):
        stored = cut_lineage(extend_components(stored, links.filter(batch == number)))
    return stored.select(F.col("node").alias("message_id"), "root")


@add("X04_feature_map", ("messages",), " SELECT message_id, " + " || ';' || ".join(
    f"'{c}={{' || coalesce('\"v\":' || " + (c if c == "forwarded_count" else f"'\"' || {c} || '\"'") + ", '') || '}'" for c in sorted(_SIMPLE)) + " AS features FROM messages")
def feature_map(load):
    """Features of every message by name, a missing value as an empty record."""
    entries = F.array_sort(F.map_entries(V.feature_map(list(_SIMPLE))))
    return load("messages").select("message_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("features"))


@add("X04_flat_features")
def flat_features(load):
    """Explaining features of every message as name and value."""
    mapped = dossier_features(build_dossier(tables(load), lists=False))
    return mapped.select("message_id", F.explode("features").alias("feature", "value")).groupBy("feature").agg(
        F.countDistinct("value").alias("n_values"), F.count_if(F.col("value") != "{}").alias("n_present"))


@add("R13_consistency_audit")
def consistency_audit(load):
    """The audit with the full feature row as explanation."""
    features = dossier_features(build_dossier(tables(load), lists=False))
    return consistency_report(load("messages"), load("decisions"), features)["summary"]
