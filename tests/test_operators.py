import random
from datetime import datetime, timedelta
from functools import reduce
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelake import config as C
from triagelake.operators.ranks import nearest_rank
from triagelake.operators import context as X, divergence as V, engagement as E, evaluation as M, similarity as S
from triagelake.operators.brand import brand_integrity
from triagelake.operators import retrieval as R
from triagelake.operators.retrieval import rank_history
from triagelake.operators.running import median_before, totals_before

NOON = datetime(2026, 7, 1, 12)


def test_totals_and_medians_before_match_brute_force_on_a_hot_key(spark):
    rng = random.Random(3)
    # One key holds most rows; times and values repeat.
    events = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(3)}", rng.randrange(400) * 500000, rng.choice([1.0, 2.0, 2.0, 5.5, rng.random()]))
              for _ in range(600)]
    asks = [(f"q{i}", "hot" if i % 2 else f"k{i % 5}", rng.randrange(420) * 500000) for i in range(120)]
    e = spark.createDataFrame(events, "k string, at_us long, v double").withColumn("n", F.lit(1))
    q = spark.createDataFrame(asks, "id string, k string, at_us long")
    got = {r["id"]: r["n"] for r in totals_before(q, e, ["k"], ["n"], slice_seconds=7).collect()}
    seen = {i: [v for k2, t2, v in events if k2 == k and t2 < t] for i, k, t in asks}
    assert got == {i: len(v) for i, v in seen.items()}
    for rows in (10 ** 6, 20):
        found = {r["id"]: r["median"] for r in median_before(q, e, ["k"], "v", window_rows=rows).collect()}
        assert found == {i: (median(v) if v else None) for i, v in seen.items()}


def _chat(spark, n_messages=30, n_history=80):
    rng = random.Random(5)
    words = ["pay the late fee today", "good morning everyone", "the lift is being repaired", "your parcel left the warehouse"]

    def row(i, base):
        return (f"m{base + i:05d}", "u1", rng.choice(["personal", "group", "business"]), "g1", f"b{rng.randrange(2)}", f"s{rng.randrange(3)}",
                NOON + timedelta(minutes=rng.randrange(5000)), rng.choice(words) + f" {rng.randrange(4)}" if rng.random() > 0.1 else "")

    schema = "message_id string, user_id string, conversation_type string, group_id string, business_id string, sender_user_id string, created_at timestamp_ntz, message_text string"
    messages = spark.createDataFrame([row(i, 0) for i in range(n_messages)], schema)
    history = spark.createDataFrame([row(i, 1000) for i in range(n_history)], schema)
    events = history.select("user_id", "message_id", (F.hash("message_id") % 2 == 0).alias("message_opened"), F.lit(False).alias("message_replied"),
                            F.lit(3.0).alias("reaction_time_minutes"), (F.hash("message_id") % 3 == 0).alias("notification_dismissed"),
                            F.lit(False).alias("muted_after_message"), F.lit(False).alias("message_reported"))
    return E.prepare(messages), E.with_events(E.prepare(history), events)


def test_ranking_does_not_depend_on_the_cell_grid(spark):
    messages, history = _chat(spark)
    plain = lambda rows: [
        (r["message_id"], r["max_jaccard"], r["duplicate_count"], [(e["history_message_id"], e["score"]) for e in r["evidence"]],
         [(e["history_message_id"], e["jaccard"]) for e in r["near_duplicates"]]) for r in sorted(rows)]
    one = plain(rank_history(messages, history).collect())
    split = plain(rank_history(messages, history, block_rows=7).collect())
    assert one == split and len(one) == 30 and any(r[3] for r in one)


def test_burst_window_is_half_open(spark):
    schema = "message_id string, user_id string, peer_id string, created_at timestamp_ntz"
    m = E.with_micros(spark.createDataFrame([("m", "u", "p", NOON), ("x", "u", None, NOON)], schema))
    h = E.with_micros(spark.createDataFrame([
        ("a", "u", "p", NOON - timedelta(hours=24)), ("b", "u", "p", NOON - timedelta(hours=24, microseconds=1)),
        ("c", "u", "p", NOON), ("d", "u", "p", NOON - timedelta(microseconds=1)), ("e", "u", None, NOON - timedelta(hours=1))], schema))
    assert {r[0]: r[1] for r in E.sender_burst(m, h).collect()} == {"m": 2, "x": 0}


def test_duplicate_users_take_the_first_row(spark):
    users = spark.createDataFrame([("u", "late", 2), ("u", "first", 1)], "user_id string, w string, position int")
    assert X.first_per_key(users, "user_id").head()["w"] == "first"


def test_brand_verdicts(spark):
    rows = [
        ("i", "x", "B", "c", False, "a.com", "b.com", 364, 179, 30), ("s1", "x", "B", "c", True, "a.com", "b.com", 364, 179, 30),
        ("s2", "x", "B", "c", False, None, "b.com", 900, 900, 0), ("s3", "x", "B", "c", True, "a.com", "a.com", 900, 900, 30),
        ("c", "x", "B", "c", True, None, "b.com", 1, 1, 29), ("e", "x", "B", "c", False, "a.com", "b.com", 365, 179, 30)]
    frame = spark.createDataFrame(rows, "business_id string, display_name string, brand_name string, category string, verified boolean, official_domain string, "
                                        "domain_used_by_sender string, account_age_days int, domain_used_by_sender_age_days int, user_reports_30d int")
    got = {r["business_id"]: (r["brand_verdict"], r["verdict_basis"]) for r in brand_integrity(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {"i": "impersonation", "s1": "suspect", "s2": "suspect", "s3": "suspect", "c": "clean", "e": "suspect"}
    assert got["c"][1] == ["official_domain_absent", "account_new", "sender_domain_new"]


def _grams(t):
    return {t[i:i + 3] for i in range(len(t) - 2)}


def test_links_and_clusters_match_brute_force_with_hot_copies(spark):
    rng = random.Random(11)
    base = "the quick brown fox jumps over the lazy dog near the river bank at noon"
    texts = [base] * 40 + [base + f" {rng.randrange(50)}" for _ in range(60)] + [
        "".join(rng.choice("abcde ") for _ in range(60)) for _ in range(40)] + ["ab", ""]
    other = "water supply stops between ten and noon for repairs on the third floor"
    texts += [other + " " + str(rng.randrange(30)) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(f"t{i:04d}", t, i) for i, t in enumerate(texts)]
    grams = {i: _grams(" ".join("".join(c if c.isalnum() else " " for c in t).split())) for i, t, _ in rows}
    near = {i: [] for i, _, _ in rows}
    for a, ga in grams.items():
        for b, gb in grams.items():
            if a != b and ga and gb and len(ga & gb) / len(ga | gb) > 0.85:
                near[a].append(b)
    frame = spark.createDataFrame(rows, "id string, text string, position int")
    for block in (512, 8):
        links, members = S.near_duplicate_links(frame.select("id", "text"), block_rows=block)
        first = {r["id"]: r["first_id"] for r in S.first_near_duplicate(links, members).collect()}
        assert first == {i: min(n) for i, n in near.items() if n and min(n) < i}
    root = {}
    for i in sorted(near):
        stack = [i] if i not in root else []
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += near[x]
    sizes = {r: sum(1 for v in root.values() if v == r) for r in set(root.values())}
    got = {r["id"]: (r["root"], r["cluster_number"]) for r in S.near_duplicate_clusters(frame, block_rows=8).collect()}
    assert {i: r for i, (r, _) in got.items()} == {i: r for i, r in root.items() if sizes[r] > 1}
    assert sorted({n for _, n in got.values()}) == list(range(1, len({r for r, _ in got.values()}) + 1))


def _alike(rng, n):
    """Texts of one vocabulary, some of them near copies and some of one size, and the similarity of any two."""
    letters = ["".join(rng.choice("abcd") for _ in range(rng.choice([20, 60, 61, 200]))) for _ in range(n // 2)]
    near = [t[:k] + rng.choice("abcde\U0001f600") + t[k + 1:] for t in letters for k in [rng.randrange(len(t))]]
    texts = {f"t{i:04d}": t for i, t in enumerate(rng.sample(letters + near, n))}
    grams = {i: _grams(t) for i, t in texts.items()}
    return texts, lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])


def _parts_of(ids, pairs):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_cells_and_buckets_give_links_of_the_same_meaning(spark):
    """Comparing all texts of like size connects what the buckets connect, and holds each text's first partner."""
    texts, similar = _alike(random.Random(23), 160)
    pairs = {(a, b): similar(a, b) for a in texts for b in texts if a < b and similar(a, b) > 0.85}
    assert len(pairs) > 40
    reps = S.cut_lineage(S._gram_sets(spark.createDataFrame(list(texts.items()), "id string, words string")))
    bands = S._sizes(reps, 0.85)
    blocked = [S.blocked_links(reps, 0.85, bands, rows) for rows in (8192, 7)]
    buckets = [S.bucketed_links(reps, 0.85, rows) for rows in (512, 8)]
    for links in (*blocked, *buckets, S.representative_links(reps, 0.85, 512)):
        got = {(r["id"], r["other"]): r["jaccard"] for r in links.collect()}
        assert got.items() <= pairs.items()
        assert _parts_of(texts, got) == _parts_of(texts, pairs)
        first = lambda found: {i: min(b if a == i else a for a, b in found if i in (a, b)) for pair in found for i in pair}
        assert first(got) == first(pairs)
    # Too many pairs left over for the cells' price: the buckets give up before they form them.
    assert S.bucketed_links(reps, 0.85, 512, most_pairs=0) is None


def test_a_cell_returns_few_links_and_verifies_in_parts(monkeypatch):
    texts, similar = _alike(random.Random(29), 90)
    copies = {f"x{i:03d}": "the lift on the third floor is being repaired until noon " + str(i % 10) * (i % 3) for i in range(200)}
    sets = {i: sorted({int(ord(t[k])) << 42 | ord(t[k + 1]) << 21 | ord(t[k + 2]) for k in range(len(t) - 2)}) for i, t in (texts | copies).items()}
    size = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    assert all(S._unpacked(x).tolist() == g for x, g in zip(S._packed.func(pd.Series([np.array(g) for g in sets.values()])), sets.values()))
    monkeypatch.setattr(S, "_PLANE", 64)
    for right, checked in ((False, 1 << 20), (True, 50)):
        monkeypatch.setattr(S, "_CHECKED_PAIRS", checked)
        side = {i: right and k % 2 == 1 for k, i in enumerate(sets)}
        table = pa.table({"cell": [0] * len(sets), "right": [side[i] for i in sets], "id": list(sets), "n": pa.array([len(g) for g in sets.values()], pa.int32()),
                          "packed": S._packed.func(pd.Series([np.array(g) for g in sets.values()]))})
        rows = S._linked_cell(0.85)(table).to_pylist()
        pairs = [(a, b) for a in sets for b in sets if a < b and (not right or side[a] != side[b]) and size(a, b) > 0.85]
        got = {(r["id"], r["other"]) for r in rows}
        assert got <= set(pairs) and len(rows) == len(got) < 2 * len(sets) < len(pairs)
        assert all(abs(r["jaccard"] - size(r["id"], r["other"])) < 1e-12 for r in rows)
        assert _parts_of(sets, got) == _parts_of(sets, pairs)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "id string, other string")
    got = {r["node"]: r["root"] for r in S.connected_components(links).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(61)}, "z1": "z1", "z2": "z1"}


def test_divergence_counts_match_pairs(spark):
    rng = random.Random(2)
    rows = [(1, f"m{i}", rng.choice(["notify", "mute", "digest"]), rng.choice(["x", "y", None]), rng.randrange(2)) for i in range(40)]
    frame = spark.createDataFrame(rows, "cluster_number int, id string, action string, f string, g int")
    members = frame.withColumn("features", V.feature_map(["f", "g"]))
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:] if a[2] != b[2]]
    total = V.cluster_divergence(members).head()
    assert total["divergent_pairs"] == len(pairs)
    assert total["unexplained_pairs"] == sum(a[3:] == b[3:] for a, b in pairs)
    by = {r["feature"]: r["differing_pairs"] for r in V.feature_divergence(members).collect()}
    assert by == {"f": sum(a[3] != b[3] for a, b in pairs), "g": sum(a[4] != b[4] for a, b in pairs)}
    assert V.divergence_witnesses(members).count() == 80


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "message_id string, action string, message_type string, confidence double, evidence_message_ids string")


def test_metrics_with_known_answers(spark):
    gold = _labelled(spark, [("1", "mute", "scam", 0.9, "a"), ("2", "notify", "personal", 0.7, "none")])
    pred = _labelled(spark, [("1", "notify", "scam", 0.8, "a;b"), ("2", "mute", "promotion", 0.4, "none")])
    pairs = M.pair_with_gold(gold, pred)
    m = M.metrics(pairs).head()
    assert (m["action_accuracy"], m["type_accuracy"], m["joint_accuracy"]) == (0.0, 0.5, 0.0)
    assert (m["mute_to_notify"], m["scam_to_notify"], m["notify_to_mute"]) == (1, 1, 1)
    assert (m["evidence_precision"], m["evidence_recall"]) == (0.5, 1.0) and m["evidence_f1"] == pytest.approx(2 / 3)
    assert m["calibration_error"] == pytest.approx(0.2)
    assert (M.confusion(pairs).count(), M.confusion(pairs, "type").count(), M.reliability(pairs).count()) == (9, 121, 20)


def test_missing_predictions_count_as_wrong(spark):
    gold = _labelled(spark, [("1", "mute", "scam", 0.9, "a;b"), ("2", "notify", "personal", 0.7, "none")])
    m = M.metrics(M.pair_with_gold(gold, gold.filter("message_id = '2'"))).head()
    assert (m["action_accuracy"], m["fn"], m["missing_predictions"]) == (0.5, 2, 1)
    assert m["calibration_error"] == pytest.approx(0.5)


def test_composite(spark):
    row = spark.createDataFrame([(0.8, 0.6, 0.5, 0.2)], "action_accuracy double, type_accuracy double, evidence_f1 double, calibration_error double")
    assert M.composite_score(row, F.lit(1.0)).head()[0] == pytest.approx(0.735)
    assert M.composite_score(row).head()[0] == pytest.approx(0.585)


def test_median_of_a_key_with_few_events_and_many_queries(spark):
    events = [("k", 10 * i, float(i % 7)) for i in range(5)]
    asks = [(f"q{i}", "k", i % 60) for i in range(4000)] + [("lone", "other", 5)]
    e = spark.createDataFrame(events, "k string, at_us long, v double")
    got = {r["id"]: r["median"] for r in median_before(spark.createDataFrame(asks, "id string, k string, at_us long"), e, ["k"], "v").collect()}
    seen = {i: [v for k2, t2, v in events if k2 == k and t2 < t] for i, k, t in asks}
    assert got == {i: (median(v) if v else None) for i, v in seen.items()}


def test_nearest_rank(spark):
    noise = random.Random(5)
    for values in ([], [None], [3.0], [1.0, 1.0, 2.0], [noise.choice([0.5, 1.5, noise.random()]) for _ in range(777)]):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        held = sorted(v for v in values if v is not None)
        for share in (0.05, 0.5, 0.95, 1.0):
            expected = next((v for k, v in enumerate(held, 1) if k >= share * len(held) - 1e-9), None)
            assert nearest_rank(rows, "v", share).collect()[0]["value"] == expected


def test_crowded_slices_are_cut_again(spark):
    """A key whose rows crowd one hour, one minute and one instant, against brute force, and spread over tasks."""
    noise = random.Random(11)
    hour = 7 * 3_600_000_000
    at = lambda: noise.choice([noise.randint(0, 10 * 3_600_000_000), hour + noise.randint(0, 59_000_000), hour + noise.randint(0, 900), hour + 5])
    events = [("hot" if k % 4 else f"k{k % 3}", at(), k % 5) for k in range(3000)]
    asks = [(k, "hot" if k % 3 else f"k{k % 4}", at()) for k in range(600)]
    e = spark.createDataFrame(events, "k string, at_us long, n long")
    q = spark.createDataFrame(asks, "id long, k string, at_us long")
    expected = {i: sum(n for x, t, n in events if x == k and t < at_) for i, k, at_ in asks}
    for rows in (10_000, 100, 10):
        found = totals_before(q, e, ["k"], ["n"], slice_rows=rows)
        assert {r["id"]: r["n"] for r in found.collect()} == expected
        assert found.columns == ["k", "at_us", "id", "n"]


def test_medians_take_counts_they_are_given(spark):
    noise = random.Random(5)
    events = [(f"k{k % 3}", noise.randint(0, 50), noise.choice([None, 1.0, 2.5, 7.0])) for k in range(200)]
    asks = [(k, f"k{k % 4}", noise.randint(0, 60)) for k in range(80)]
    e = spark.createDataFrame(events, "k string, at_us long, v double")
    q = spark.createDataFrame(asks, "id long, k string, at_us long")
    counted = totals_before(q, e.withColumn("reacted", F.col("v").isNotNull().cast("long")), ["k"], ["reacted"])
    for rows in (2048, 4):
        found = median_before(counted, e, ["k"], "v", window_rows=rows, counted="reacted")
        seen = {i: [v for x, t, v in events if x == k and t < at and v is not None] for i, k, at in asks}
        assert {r["id"]: (r["median"], r["reacted"]) for r in found.collect()} == {i: (median(v) if v else None, len(v)) for i, v in seen.items()}


def test_components_grow_by_batches(spark):
    noise = random.Random(7)
    links = [(f"n{noise.randint(0, 160):03}", f"n{noise.randint(0, 160):03}") for _ in range(150)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, other string")
    stored = S.connected_components(frame(links[:40]))
    for at in (40, 41, 100):
        stored = S.extend_components(stored, frame(links[at:{40: 41, 41: 100, 100: 150}[at]]))
    whole = S.connected_components(frame(links))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, whole.collect()))


def test_cells_share_a_batch_and_a_cell_crosses_batches(spark):
    """Recipients are many and small: one call ranks a batch of cells, wherever the batches are cut."""
    import pandas as pd

    from triagelake.operators.retrieval import _cell_ranker, _whole_cells

    messages, history = _chat(spark)
    both = [reduce(lambda a, b: a.unionByName(b), [
        df.withColumns({"user_id": F.lit(u).cast("string"), "message_id": F.concat(F.lit(f"{u}-"), "message_id")}) for u in ("u1", None, "u0")]) for df in (messages, history)]
    frame = pd.DataFrame({"user_id": [None] * 3 + ["a"] * 4 + ["b"], "cell_m": [0] * 8, "cell_h": [0, 0, 1, 0, 0, 0, 0, 0], "n": range(8)})
    for size in range(1, 9):
        cut = list(_whole_cells(frame.iloc[i:i + size] for i in range(0, 8, size)))
        assert [n for f in cut for n in f["n"]] == list(range(8))
        ends = [f[["user_id", "cell_h"]].astype(str).agg("-".join, axis=1) for f in cut]
        assert all(a.iloc[-1] != b.iloc[0] for a, b in zip(ends, ends[1:]))
    plain = lambda rows: {r.message_id: (r.max_jaccard, r.duplicate_count, [(e.history_message_id, e.score) for e in r.evidence]) for r in rows}
    alone = plain(rank_history(messages, history).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        together = plain(rank_history(*both).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in ("u1", "u0", None):
        for name, (top, n, evidence) in alone.items():
            assert together[f"{u}-{name}"] == (top, n, [(f"{u}-{h}", s) for h, s in evidence])
    assert list(_cell_ranker(2, 2, 0.1, 0.4)(iter([]))) == []
    textless = [df.withColumn("message_text", F.when(F.hash("message_id") % 4 != 0, F.col("message_text"))) for df in (messages, history)]
    empty = [df.fillna("", ["message_text"]) for df in textless]
    assert plain(rank_history(*textless).collect()) == plain(rank_history(*empty).collect())


def test_trigram_sets_of_a_batch():
    """Texts of all lengths and planes keep their own sets."""
    from triagelake.operators.retrieval import _GramSets

    texts = ["", "ab", "aba", "ababab", "abc", "\U0001f600\U0001f600\U0001f600", "\U0001f600\U0001f600\U0001f600a", "xabcx"]
    sets, all_ = _GramSets(texts), np.arange(len(texts))
    grams = [{t[i:i + 3] for i in range(len(t) - 2)} for t in texts]
    found = sets.jaccard(all_, all_)
    assert sets.sizes.tolist() == [len(g) for g in grams] and len(sets.numbers) == sum(sets.sizes)
    for i, left in enumerate(grams):
        for j, right in enumerate(grams):
            assert found[i, j] == pytest.approx(len(left & right) / len(left | right)) if left and right else np.isnan(found[i, j])
    assert _GramSets([]).vocabulary == 0


def test_a_cell_returns_one_row_per_message_and_repeated_ids_share_their_lists(spark):
    """Lists leave Python whole; ids that come twice, and recipients with several cells, are merged with k entries at most."""
    import pyarrow as pa

    from triagelake.operators.retrieval import _cell_ranker

    messages, history = _chat(spark)
    sides = [R._side(messages, True), R._side(history, False)]
    zero = F.lit(0).cast("long")
    rows = sides[0].unionByName(sides[1]).withColumn("cell_m", zero).withColumn("cell_h", zero).orderBy("user_id").toPandas()
    n = messages.select("user_id", "message_id").join(history.select("user_id").distinct(), "user_id").count()
    out = list(_cell_ranker(3, 2, 0.0, 0.1)(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)])))
    assert sum(b.num_rows for b in out) == n
    assert all(len(e or []) <= 3 and len(d or []) <= 2 for b in out for e, d in zip(b["evidence"].to_pylist(), b["near_duplicates"].to_pylist()))

    def plain(rows):
        return sorted((r.message_id, r.max_jaccard, r.duplicate_count, [(e.history_message_id, e.score, e.created_at) for e in r.evidence],
                       [(e.history_message_id, e.text_excerpt) for e in r.near_duplicates]) for r in rows)

    once = plain(rank_history(messages, history).collect())
    twice = plain(rank_history(messages.unionByName(messages), history).collect())
    split = plain(rank_history(messages.unionByName(messages), history, block_rows=7).collect())
    assert twice == split and len(twice) == 2 * len(once)
    for m, top, count, evidence, near in once:
        found = [r for r in twice if r[0] == m]
        assert len(found) == 2 and all(r[1] == top and r[2] == 2 * count for r in found)
        for r in found:
            k = min(2 * len(evidence), C.EVIDENCE_TOP_K)
            assert sorted(s for _, s, _ in r[3]) == sorted(-s for s, _ in sorted([(-s, h) for h, s, _ in evidence] * 2)[:k])
