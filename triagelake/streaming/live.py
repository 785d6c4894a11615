"""Routing and burst counting over a stream of messages."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from triagelake import config as C
from triagelake.functions.scores import resolve_peer
from triagelake.operators.context import business_relationship, latest_per_key
from triagelake.plans.dossier import content_signals, sender_identity
from triagelake.plans.router import route
from triagelake.session import spread


def stream_features(messages: DataFrame, accounts: DataFrame, relations: DataFrame, peer_rates: DataFrame) -> DataFrame:
    """Router inputs of streamed messages by stream-static joins.

    ``peer_rates`` holds user_id, peer_id, peer_n and peer_dismiss_rate of a finished
    history snapshot. A batch has few files, so its texts are dealt to all tasks.
    """
    messages = spread(messages, "message_id")
    _, peer = resolve_peer(F.col("conversation_type"), F.col("business_id"), F.col("sender_user_id"))
    row = sender_identity(content_signals(messages.withColumn("peer_id", peer)), accounts)
    row = row.join(peer_rates, ["user_id", "peer_id"], "left")
    known = relations.select("user_id", "business_id", F.col("promotions_opted_out_at").isNotNull().alias("opted_out"))
    asked = F.when(F.col("conversation_type") == "business", F.col("business_id"))
    row = row.withColumn("_b", asked).join(known.withColumnRenamed("business_id", "_b"), ["user_id", "_b"], "left").drop("_b")
    return row.withColumns({"opted_out": F.coalesce("opted_out", F.lit(False)), "peer_n": F.coalesce("peer_n", F.lit(0))})


def _into_batches(rows: DataFrame, store: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each batch writes its own folder and overwrites it when it is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(store, f"batch={number}"))

    return (rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def route_stream(features: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Route every new message into an append-only store.

    A restart neither loses nor repeats rows; the newest batch wins when an id comes again.
    """
    return _into_batches(route(features), store, checkpoint, "append")


def read_routed(spark: SparkSession, store: str) -> DataFrame:
    return latest_per_key(spark.read.parquet(store), "message_id", "batch")


def lateness(messages: DataFrame) -> str:
    """The delay that keeps every row of a finished backlog, in whatever order its files are read."""
    span = messages.agg(F.coalesce(F.unix_timestamp(F.max("created_at").cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp")),
                                   F.lit(0)).alias("s")).first()["s"]
    return f"{span + 3600} seconds"


def store_bursts(counts: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of every hour a batch has changed, hours still open included."""
    return _into_batches(counts, store, checkpoint, "update")


#: Stored counts whose windows one task works out.
WINDOW_ROWS = 50_000


def read_bursts(spark: SparkSession, store: str, hours: int = C.BURST_WINDOW_HOURS) -> DataFrame:
    """The count of every window of ``hours`` that starts on an hour and holds a message.

    It sums the newest counts of its hours. The hours of a recipient and sender meet in one task, which holds as
    many windows of a pair as its time has hours; the number of tasks follows the stored counts.
    """
    stored = spark.read.parquet(store)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // WINDOW_ROWS))
    pair = ["user_id", "peer_id"]
    newest = stored.repartition(parts, *pair).groupBy(*pair, "hour").agg(F.max_by("n", "batch").alias("n"))
    starts = F.sequence(F.col("hour") - F.expr(f"INTERVAL '{hours - 1}' HOUR"), F.col("hour"), F.expr("INTERVAL '1' HOUR"))
    counts = newest.select(*pair, F.explode(starts).alias("window_start"), "n").groupBy(*pair, "window_start").agg(F.sum("n").alias("n"))
    return counts.select(*pair, "window_start", (F.col("window_start") + F.expr(f"INTERVAL '{hours}' HOUR")).alias("window_end"), "n")


def burst_stream(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Messages per recipient, sender and hour, of which ``read_bursts`` makes windows that start every hour.

    The state holds one count for each hour with a message, not one for each window the message lies in. Rows of an
    hour that ended ``late`` or more behind the newest one are left out; ``lateness`` gives a delay for a backlog.
    """
    _, peer = resolve_peer(F.col("conversation_type"), F.col("business_id"), F.col("sender_user_id"))
    return (
        messages.withColumn("peer_id", peer).filter(F.col("peer_id").isNotNull())
        # Event time must be an instant; the wall clock is read in the session's zone.
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
        .withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "user_id", "peer_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", "peer_id", F.col("w.start").alias("hour"), "n")
    )


def burst_rows(messages: DataFrame, asked: bool) -> DataFrame:
    """What the exact count takes of messages (``asked``) or of history, which is counted."""
    _, peer = resolve_peer(F.col("conversation_type"), F.col("business_id"), F.col("sender_user_id"))
    return messages.select("message_id", "user_id", peer.alias("peer_id"), F.col("created_at").cast("timestamp").alias("created_at"),
                           F.lit(asked).alias("asked")).where("peer_id IS NOT NULL")


_TOLD = "message_id string, salt int, n long"
_KEPT = ("names array<string>, fact_of array<int>, times array<long>, counts array<long>, "
         "ask_of array<int>, ids array<string>, salts array<int>, asked_at array<long>, told array<long>")
#: Rows that one state should hold, so that calls into Python are few and no state is large.
STATE_ROWS = 20_000


def buckets_for(rows: DataFrame, salts: int = 4) -> int:
    """Buckets for a finished backlog of ``burst_rows``; a message counts once for each salt."""
    n = rows.agg(F.sum(F.when(F.col("asked"), salts).otherwise(1)).alias("n")).first()["n"] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * parts, -(-n // STATE_ROWS))


def exact_bursts(rows: DataFrame, late: str, hours: int = C.BURST_WINDOW_HOURS, salts: int = 4, buckets: int = 64) -> DataFrame:
    """(message_id, salt, n): history of the same recipient and sender in the ``hours`` before each message.

    ``rows`` is a stream of ``burst_rows``. A message is told its count when it arrives and again whenever an
    earlier row that came later changes it, until the watermark has reached it; rows that the watermark
    has reached are left out, as ``late`` says. History is dealt over ``salts`` keys, so a busy sender is held
    by as many tasks; a message is asked in each, and its counts add up. Many keys share one of the ``buckets``:
    its state holds their names, a count per key and instant of the window, and the messages still open.
    """
    span = hours * 3_600_000_000

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else ([],) * 9
        floor = state.getCurrentWatermarkMs() * 1000
        new = pd.concat(list(batches), ignore_index=True)
        new["at"] = new["created_at"].astype("datetime64[us]").astype("int64")
        new = new[new["at"] > floor]
        asked = new["asked"].to_numpy(bool)
        of, names = pd.factorize(np.concatenate([np.asarray(old[0], object), new["name"].to_numpy(object)]))
        of = of[len(old[0]):].astype(np.int64)
        joined = lambda kept, fresh, kind=np.int64: np.concatenate([np.asarray(kept, kind), fresh]).astype(kind)
        at = new["at"].to_numpy(np.int64)
        fact_of, times = joined(old[1], of[~asked]), joined(old[2], at[~asked])
        counts = joined(old[3], np.ones(int((~asked).sum())))
        ask_of, ids = joined(old[4], of[asked]), joined(old[5], new["message_id"].to_numpy(object)[asked], object)
        salt, asked_at = joined(old[6], new["salt"].to_numpy()[asked]), joined(old[7], at[asked])
        told = joined(old[8], np.full(int(asked.sum()), -1))
        # Key and instant as one ordered number.
        instants = np.unique(np.concatenate([times, asked_at, asked_at - span]))
        place = lambda of, at: of * len(instants) + np.searchsorted(instants, at)
        facts, where = np.unique(place(fact_of, times), return_inverse=True)
        counts = np.bincount(where, counts, len(facts)).astype(np.int64)
        if len(facts):
            fact_of, times = facts // len(instants), instants[facts % len(instants)]
        before = np.concatenate([[0], np.cumsum(counts)])
        n = before[np.searchsorted(facts, place(ask_of, asked_at))] - before[np.searchsorted(facts, place(ask_of, asked_at - span))]
        changed = n != told
        yield pd.DataFrame({"message_id": ids[changed], "salt": salt[changed].astype(np.int32), "n": n[changed]})
        # What lies behind the watermark changes no more; what no open or coming message counts can go.
        stays, recent = asked_at > floor, times > floor - span
        used, code = np.unique(np.concatenate([fact_of[recent], ask_of[stays]]), return_inverse=True)
        held = int(recent.sum())
        state.update((list(names[used]), code[:held].tolist(), times[recent].tolist(), counts[recent].tolist(), code[held:].tolist(),
                      ids[stays].tolist(), salt[stays].tolist(), asked_at[stays].tolist(), n[stays].tolist()))
        newest = max([int(x.max()) for x in (times[recent], asked_at[stays]) if len(x)], default=floor)
        state.setTimeoutTimestamp(max(newest + span, floor) // 1000 + 1)

    spread = F.when(F.col("asked"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("message_id"), F.lit(salts)).cast("int")))
    # A missing recipient is left out of the name, so it meets only its like.
    name = F.to_json(F.struct("user_id", "peer_id", "salt"))
    return (rows.withWatermark("created_at", late).withColumn("salt", F.explode(spread)).withColumn("name", name)
            .withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))
            .select("message_id", "name", "salt", "created_at", "asked", "bucket")
            .groupBy("bucket").applyInPandasWithState(update, _TOLD, _KEPT, "update", "EventTimeTimeout"))


def store_exact_bursts(counts: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    return _into_batches(counts, store, checkpoint, "update")


def read_exact_bursts(spark: SparkSession, store: str) -> DataFrame:
    """The newest count of every message, over all salts."""
    newest = spark.read.parquet(store).groupBy("message_id", "salt").agg(F.max_by("n", "batch").alias("n"))
    return newest.groupBy("message_id").agg(F.sum("n").alias("sender_burst_24h"))
