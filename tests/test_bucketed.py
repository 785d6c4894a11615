"""Stored buckets: the same joins without an exchange, under a hot recipient too."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from triagelake.operators import engagement as E
from triagelake.plans.dossier import Tables, enriched_history
from triagelake.sources.bucketed import REACTION_KEYS, Reactions, bucket_count, open_bucketed

SF = "/root/testdata/sf0.001"
HISTORY = "user_id string, message_id string, text string"
EVENTS = ("user_id string, message_id string, message_opened boolean, message_replied boolean, reaction_time_minutes double, "
          "notification_dismissed boolean, muted_after_message boolean, message_reported boolean")


def _rows(spark, first, last):
    """Two thirds of the rows are one recipient's; some keys are null."""
    h = spark.range(first, last).select(
        F.when(F.col("id") % 50 == 7, F.lit(None)).when(F.col("id") % 3 == 0, F.concat(F.lit("u"), F.col("id"))).otherwise(F.lit("hot")).alias("user_id"),
        F.concat(F.lit("m"), F.col("id")).alias("message_id"), F.lit("text").alias("text"))
    e = h.where("abs(hash(message_id)) % 2 = 0").select(
        "user_id", "message_id", F.lit(True).alias("message_opened"), F.lit(False).alias("message_replied"), F.lit(1.5).alias("reaction_time_minutes"),
        *[F.lit(False).alias(c) for c in ("notification_dismissed", "muted_after_message", "message_reported")])
    return h, e


def _sorted(df):
    return sorted(map(repr, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    """Small tables would be broadcast; large ones are not."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_stored_tables_join_without_exchange(spark, tmp_path, shuffled_joins):
    (h, e), (h2, e2) = _rows(spark, 0, 6000), _rows(spark, 6000, 9000)
    assert "Exchange" in _plan(E.with_events(h, e))
    stored = Reactions.store(h, e, str(tmp_path / "it's"), bucket_rows=500)
    assert stored.buckets == 16
    # One file a bucket, and the hot recipient in all of them.
    files = sorted(n for n in os.listdir(tmp_path / "it's" / "history") if n.endswith(".parquet"))
    assert len(files) == 16
    spread = stored.tables(spark)[0].where("user_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(spread) == 16 and max(r[1] for r in spread) < 2 * min(r[1] for r in spread)
    stored.append(h2, e2)
    joined = E.with_events(*stored.tables(spark))
    assert "Exchange" not in _plan(joined)
    assert _sorted(joined) == _sorted(E.with_events(h.unionByName(h2), e.unionByName(e2)))


def test_another_session_opens_what_is_stored(spark, tmp_path, shuffled_joins):
    h, e = _rows(spark, 0, 500)
    stored = Reactions.store(h, e, str(tmp_path / "kept"))
    found = [spark.table(open_bucketed(spark, str(tmp_path / "kept" / part), ddl, REACTION_KEYS, stored.buckets))
             for part, ddl in (("history", HISTORY), ("events", EVENTS))]
    joined = E.with_events(*found)
    assert "Exchange" not in _plan(joined) and _sorted(joined) == _sorted(E.with_events(h, e))


def test_empty_tables_and_bucket_numbers(spark, tmp_path):
    h, e = _rows(spark, 0, 0)
    joined = E.with_events(*Reactions.store(h, e, str(tmp_path / "none")).tables(spark))
    assert joined.collect() == [] and "has_event" in joined.columns
    assert [bucket_count([spark.range(n)], 10) for n in (0, 80, 81, 170)] == [8, 8, 16, 32]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_history_of_a_run_is_not_exchanged_for_its_events(spark, tmp_path, shuffled_joins):
    t = Tables.from_driver(spark, SF)
    kept = t.bucketed(str(tmp_path / "run"))
    assert "Exchange" not in _plan(enriched_history(kept))
    assert _sorted(enriched_history(kept)) == _sorted(enriched_history(t))
    assert kept.messages is t.messages and replace(kept, history=t.history, message_events=t.message_events) == t
