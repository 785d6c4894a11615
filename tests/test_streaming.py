"""The exact trailing burst on a stream: rows out of order, late rows, busy senders."""

import random
from datetime import datetime, timedelta

import pytest

from triagelake.streaming import live

SCHEMA = "message_id string, user_id string, peer_id string, created_at timestamp, asked boolean"
START = datetime(2024, 3, 1)


def _run(spark, tmp_path, batches, late, salts=4):
    source = tmp_path / "in"
    source.mkdir()
    counts = None
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        live.store_exact_bursts(live.exact_bursts(stream, late, salts=salts), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        counts = {r.message_id: r.sender_burst_24h for r in live.read_exact_bursts(spark, str(tmp_path / "out")).collect()}
    return counts


def _expected(rows):
    day = timedelta(hours=24)
    facts = [(u, p, t) for _, u, p, t, asked in rows if not asked]
    return {m: sum(u == x and p == y and at - day <= t < at for x, y, t in facts) for m, u, p, at, asked in rows if asked}


@pytest.mark.parametrize("salts", [1, 4])
def test_counts_in_any_order(spark, tmp_path, salts):
    noise, rows = random.Random(salts), []
    for k in range(400):
        at = START + timedelta(minutes=noise.choice([noise.randint(0, 4000), 1440 * noise.randint(0, 2)]))
        rows.append((f"{'q' if k % 3 == 0 else 'h'}{k}", f"u{noise.randint(0, 2)}", "busy" if k % 2 else f"p{noise.randint(0, 2)}", at, k % 3 == 0))
    noise.shuffle(rows)
    assert _run(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], "5 days", salts) == _expected(rows)


def test_late_rows_change_open_messages_only(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    first = [("q1", "u", "p", at(10), True), ("h1", "u", "p", at(9), False)]
    second = [("h2", "u", "p", at(8.5), False), ("h3", "u", "p", at(40), False), ("q2", "u", "p", at(41), True)]
    # The watermark is now two hours behind hour 41: a row of hour 39.5 counts, one of hour 9.5 comes too late.
    third = [("h4", "u", "p", at(39.5), False), ("h5", "u", "p", at(9.5), False)]
    counts = _run(spark, tmp_path, [first, second, third], "2 hours")
    assert counts == {"q1": 2, "q2": 2}


def test_keys_share_states(spark, tmp_path):
    """Very many senders of few messages are held in a few states, missing recipients apart from the others."""
    rows = [(f"{kind}{k}", None if k % 7 == 0 else f"u{k}", f"p{k % 50}", START + timedelta(minutes=k + (kind == "q")), kind == "q")
            for k in range(500) for kind in "hq"]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = live.store_exact_bursts(live.exact_bursts(stream, "5 days", buckets=6), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6
    assert {r.message_id: r.sender_burst_24h for r in live.read_exact_bursts(spark, str(tmp_path / "out")).collect()} == _expected(rows)
    assert live.buckets_for(spark.createDataFrame(rows, SCHEMA)) >= 4


def test_bursts_hold_one_count_an_hour(spark, tmp_path):
    """The state has a row for each hour with a message, not for each window of it; windows are summed when read."""
    schema = "message_id string, user_id string, conversation_type string, business_id string, sender_user_id string, created_at timestamp"
    noise = random.Random(8)
    rows = [(f"m{k}", None if k % 9 == 0 else f"u{k % 3}", "personal", None, None if k % 11 == 0 else f"p{k % 2}", START + timedelta(minutes=noise.randint(0, 6000))) for k in range(300)]
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = live.store_bursts(live.burst_stream(stream, "5 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    hour = lambda at: at.replace(minute=0)
    known = [(u, p, hour(at)) for _, u, _, _, p, at in rows if p is not None]
    expected = {}
    for u, p, at in known:
        for k in range(24):
            key = (u, p, at - timedelta(hours=k), at + timedelta(hours=24 - k))
            expected[key] = expected.get(key, 0) + 1
    found = live.read_bursts(spark, str(tmp_path / "out")).collect()
    assert {(r.user_id, r.peer_id, r.window_start, r.window_end): r.n for r in found} == expected and len(found) == len(expected)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == len(set(known))


def test_batches_join_finished_snapshots(spark, monkeypatch):
    """No batch of the routed stream works out the snapshots again."""
    from triagelake.catalog import runs

    joined, features = [], live.stream_features
    monkeypatch.setattr(live, "stream_features", lambda m, *statics: joined.extend(statics) or features(m, *statics))
    rows = runs.REGISTRY.queries["T01_streamed_router"](spark, "/root/testdata/sf0.001")
    assert len(joined) == 3 and rows.count() > 0
    for df in joined:
        plan = df._jdf.queryExecution().toString()
        assert "Aggregate" not in plan and "driver_" not in plan and "events" not in plan
