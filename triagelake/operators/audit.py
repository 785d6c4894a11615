"""Audits of finished runs: the gate's effect, run counters and sender categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from triagelake import config as C
from triagelake.functions.scanners import is_active_relationship
from triagelake.functions.scores import rate, token_cost
from triagelake.operators.ranks import nearest_rank

FALLBACK_FREE = ("submitted", "reason_repaired")


def _changed():
    return F.coalesce(F.col("action_changed"), F.lit(False)) | F.coalesce(
        (F.col("pre_action") != "") & (F.col("post_action") != "") & (F.col("pre_action") != F.col("post_action")), F.lit(False))


def gate_totals(traces: DataFrame) -> DataFrame:
    """``traces`` has message_id, pre_action, post_action, action_changed, hard_blocked, rules (array)."""
    return traces.agg(*_gate_measures())


def _gate_measures():
    return [F.count("*").alias("n_traces"), F.count_if(F.size("rules") > 0).alias("fired_rows"),
            F.count_if(_changed()).alias("changed_rows"), F.count_if("hard_blocked").alias("hard_blocked_rows")]


def watched_traces(traces: DataFrame, totals: Observation) -> DataFrame:
    """``traces`` as they are; the action that works them out leaves the ``gate_totals`` in ``totals``, without a pass of its own."""
    return traces.observe(totals, *_gate_measures())


def watched_run(rows: DataFrame, totals: Observation) -> DataFrame:
    """Rows of a run as they are, with the gate's totals, the reused rows and the fallbacks left in ``totals``."""
    trace, fresh = F.col("gate_trace"), ~F.col("resumed")
    return rows.observe(
        totals, F.count("*").alias("n_rows"), F.count_if("resumed").alias("resumed"),
        F.count_if(fresh & ~F.col("outcome").isin(*FALLBACK_FREE)).alias("fallbacks"), F.count_if(F.size("rules_fired") > 0).alias("fired_rows"),
        F.count_if(trace["_pre_gate_action"] != trace["_post_gate_action"]).alias("changed_rows"),
        F.count_if(trace["_gate_hard_blocked"]).alias("hard_blocked_rows"))


def gate_rules(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode("rules").alias("rule"), _changed().alias("changed")).groupBy("rule").agg(
        F.count("*").alias("fired"), F.count_if("changed").alias("changed"))


def gate_distribution(traces: DataFrame) -> DataFrame:
    """Action counts before and after the gate, zero rows included."""
    both = F.array(F.struct(F.col("pre_action").alias("action"), F.lit(1).alias("pre"), F.lit(0).alias("post")),
                   F.struct(F.col("post_action").alias("action"), F.lit(0).alias("pre"), F.lit(1).alias("post")))
    counts = traces.select(F.explode(both).alias("x")).select("x.*").groupBy("action").agg(
        F.sum("pre").alias("pre_gate"), F.sum("post").alias("post_gate"))
    actions = traces.sparkSession.range(1).select(F.explode(F.array(*[F.lit(a) for a in C.ACTIONS])).alias("action"))
    out = actions.join(counts, "action", "left").fillna(0, ["pre_gate", "post_gate"])
    return out.withColumn("delta", F.col("post_gate") - F.col("pre_gate"))


def gate_transitions(traces: DataFrame) -> DataFrame:
    return traces.filter(_changed()).groupBy("pre_action", "post_action").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


def changed_rows(traces: DataFrame) -> DataFrame:
    return traces.filter(_changed()).select(
        "message_id", "pre_action", "post_action",
        F.when(F.size("rules") > 0, F.array_join("rules", ", ")).otherwise("-").alias("rules"))


def run_counters(traces: DataFrame) -> DataFrame:
    """One row of run totals with the prompt-cache share; ``tail_latency`` has the slowest rows."""
    fresh = ~F.col("resumed")
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    run = traces.agg(
        F.count_if(fresh).alias("n_rows"), F.count_if("resumed").alias("resumed"),
        F.count_if(fresh & ~F.col("outcome").isin(*FALLBACK_FREE)).alias("fallbacks"),
        F.count_if(fresh & (F.col("outcome") == "refusal")).alias("refusals"),
        *[F.sum(F.when(fresh, F.col(c))).alias(c) for c in ("retries", "coercions", "tool_calls", "inspect_calls", "model_calls")],
        F.sum(F.when(fresh, F.col("cache_read_tokens"))).alias("_read"), F.sum(F.when(fresh, prompt)).alias("_prompt"),
    )
    return run.withColumns({
        "cache_hit_rate": F.coalesce(rate(F.col("_read"), F.col("_prompt")), F.lit(0.0)),
        "mean_tool_calls": F.coalesce(rate(F.col("tool_calls"), F.col("n_rows")), F.lit(0.0)),
    }).drop("_read", "_prompt")


def tail_latency(traces: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: the nearest-rank 95th percentile of the seconds of rows that were not reused, 0 without any."""
    fresh = traces.where(~F.col("resumed")).select("wall_seconds")
    return nearest_rank(fresh, "wall_seconds", share).select(F.coalesce("value", F.lit(0.0)).alias("p95_seconds"))


def counter_tables(traces: DataFrame) -> DataFrame:
    """Counts per action, outcome and gate rule in one long table."""
    fresh = traces.filter(~F.col("resumed"))
    def entry(kind, name):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    rules = F.transform("rules", lambda r: entry("gate_rule", r))
    all_entries = F.concat(F.array(entry("action", F.col("post_action")), entry("outcome", F.col("outcome"))), rules)
    return fresh.select(F.explode(all_entries).alias("x")).select("x.*").groupBy("kind", "name").agg(F.count("*").alias("n"))


def model_costs(traces: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Tokens and price per model; a model without a price keeps a null cost."""
    tokens = traces.filter(~F.col("resumed")).groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])
    table = F.create_map(*[x for name, pair in prices.items() for x in (
        F.lit(name), F.struct(F.lit(float(pair[0])).alias("i"), F.lit(float(pair[1])).alias("o")))])
    price = F.try_element_at(table, F.col("model"))
    cost = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), price["i"], price["o"])
    return tokens.withColumn("cost", cost).withColumn("unpriced", F.col("cost").isNull())


def plan_profile(rows: DataFrame) -> DataFrame:
    """What a run would process: attachments, images to open, rows without candidates."""
    return rows.groupBy(F.coalesce("media_type", F.lit("text")).alias("media_type")).agg(
        F.count("*").alias("n_rows"),
        F.count_if((F.col("media_type") == "image") & F.col("media_id").isNotNull() & F.col("file_exists")).alias("inspectable_images"),
        F.count_if(F.size("evidence") == 0).alias("without_candidates"),
    )


def first_contacts(messages: DataFrame, history: DataFrame) -> DataFrame:
    """Personal messages whose sender never wrote to the recipient before, at any time."""
    asked = messages.filter((F.col("conversation_type") == "personal") & (F.length("sender_user_id") > 0))
    seen = history.filter(F.length("sender_user_id") > 0).select("user_id", "sender_user_id").distinct()
    return asked.join(seen, ["user_id", "sender_user_id"], "left_anti")


def category_members(messages, history, accounts, relations, members) -> DataFrame:
    """message_id and audit category.

    A: verified account, used domain equal to the official one, known to the recipient,
    split by whether the relationship is live. B: first contact. C: sent by a group admin.
    """
    acc = accounts.filter(F.col("verified") & (F.col("domain_used_by_sender") == F.col("official_domain"))).select("business_id")
    rel = relations.filter(F.length("why_user_knows_account") > 0).select(
        "user_id", "business_id", is_active_relationship(F.col("why_user_knows_account")).alias("active"))
    a = messages.filter(F.col("conversation_type") == "business").join(acc, "business_id").join(rel, ["user_id", "business_id"])
    a = a.select("message_id", F.when(F.col("active"), "A_active").otherwise("A_dormant").alias("category"))
    b = first_contacts(messages, history).select("message_id", F.lit("B").alias("category"))
    admins = members.filter(F.col("role") == "admin").select("group_id", F.col("user_id").alias("sender_user_id"))
    c = messages.filter((F.col("conversation_type") == "group") & (F.length("sender_user_id") > 0)).join(admins, ["group_id", "sender_user_id"])
    return a.unionByName(b).unionByName(c.select("message_id", F.lit("C").alias("category")))


def category_audit(categories: DataFrame, actions: DataFrame) -> DataFrame:
    found = categories.join(actions.select("message_id", "action"), "message_id", "left")
    action = F.coalesce("action", F.lit("MISSING"))
    return found.groupBy("category").agg(F.count("*").alias("n"), *[F.count_if(action == a).alias(a) for a in (*C.ACTIONS, "MISSING")])
