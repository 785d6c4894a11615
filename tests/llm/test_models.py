"""Toxicity and language identification: exact parts against brute force, models on held-out rows."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import langid, toxicity
from triagelake.llm.common import held_out

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
ODD = [(1, None), (2, ""), (3, "12 34 !?"), (4, "퟿ 😀"), (5, "x " * 60_000), (None, "no id"), (6, "twice"), (6, "twice")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, 0.5, "zz") for d, t in rows], "doc_id long, text string, score double, predicted string")


def brute_segments(scores):
    """Take the best segment, then search the parts on both sides of it."""
    def search(low, high):
        best = (0.0, 0, 0)
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > best[0] + 1e-9:
                    best = (total, i, j)
        return search(low, best[1]) + [best] + search(best[2] + 1, high) if best[0] else []

    return [(i, j, s) for s, i, j in search(0, len(scores))]


def test_segments_against_brute_force():
    noise = random.Random(0)
    for _ in range(400):
        weights = [noise.choice([None, None, None, noise.uniform(0.2, 3)]) for _ in range(noise.randint(0, 30))]
        got = toxicity.segments([(i, w) for i, w in enumerate(weights) if w and w > 0.5], 0.5)
        expected = brute_segments([(w if w and w > 0.5 else 0) - 0.5 for w in weights])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, expected))


def test_segments_are_linear():
    assert len(toxicity.segments([(k * 40, 1.0 + k % 3) for k in range(200_000)], 0.5)) == 200_000


def toxic_tables(spark, n=600):
    noise = random.Random(3)
    plain = ["w%s" % "".join(noise.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        words, bad = [noise.choice(plain) for _ in range(noise.randint(20, 200))], k % 6 == 0
        for _ in range(noise.randint(3, 8) if bad else 0):
            words[noise.randrange(len(words))] = noise.choice(["grumble", "grumbling", "snarl", "snarled"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxic_documents_are_told_on_held_out_rows(spark):
    docs, labels, truth = toxic_tables(spark)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held", held_out(F.col("doc_id"))).collect()
    held = Counter((truth[r.doc_id], r.predicted) for r in scored if r.held)
    assert held[0, 1] == 0 and held[1, 0] <= 1 and held[1, 1] >= 12
    assert all((len(r.passages) > 0) or r.score < 0.5 for r in scored)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels, _ = toxic_tables(spark)
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_toxicity_of_odd_rows(spark):
    docs, labels, _ = toxic_tables(spark, 200)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(table(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(table(spark, []), model).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    for bad in (none, nulls):
        assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, bad)).collect())


@needs_data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    rows = told.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def lang_table(spark):
    noise = random.Random(1)
    syllables = {"aa": ["ba", "do", "ki", "mu"], "bb": ["sch", "ung", "tz", "ei"]}
    rows = [(k, " ".join("".join(noise.choice(syllables[v]) for _ in range(3)) for _ in range(40)), v) for k in range(200) for v in ("aa", "bb") if (k % 2 == 0) == (v == "aa")]
    return spark.createDataFrame(rows + [(900, "bado", None), (None, "badoki", "aa"), (901, None, "bb")], "doc_id long, text string, lang string")


def test_language_of_odd_rows(spark):
    docs = lang_table(spark)
    model = langid.fit(docs)
    assert model.labels == ["aa", "bb"]
    got = langid.identify(table(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert 0 <= r.score <= 1
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0 and kept.count() >= 200
    assert langid.identify(table(spark, []), model).collect() == []


def test_what_is_no_language_is_rejected(spark):
    """With two languages and no fixed limit: their own texts stay, also mixed ones; other letters and key mashing go."""
    docs = lang_table(spark)
    model, noise = langid.fit(docs), random.Random(4)
    own = [r.text for r in docs.where("text IS NOT NULL AND length(text) > 20").collect()]
    mixed = [a[:100] + " " + b[:100] for a, b in zip(own, own[1:])]
    assert sum(model.predict(t)[2] for t in own) <= 0.005 * len(own) and sum(model.predict(t)[2] for t in mixed) <= 0.01 * len(mixed)
    other = ["".join(chr(noise.randint(0x430, 0x44F)) if noise.random() < 0.8 else " " for _ in range(120)) for _ in range(50)]
    mashed = ["".join(noise.choice("qwjxvpyl ") for _ in range(120)) for _ in range(50)] + ["k" * 80, "e" * 500]
    assert sum(model.predict(t)[2] for t in other + mashed) >= 0.95 * len(other + mashed)


def test_prediction_against_the_plain_sum(spark):
    """Whole texts, read in steps, against one mean over all runs."""
    model = langid.fit(lang_table(spark))
    for text in ("badoki schung mu", "Ba  Do-12 ei", "x" * 40, " ".join(["bado", "tzei"] * 300_000)):
        points, runs = langid.codes(" " + text + " "), []
        for n in (2, 3, 4):
            runs += [langid.hashes(points[k:k + n])[-1] for k in range(len(points) - n + 1)] if len(points) < 1000 else []
        if runs:
            z = model.table[np.array(runs)].mean(axis=0, dtype=np.float64) + model.bias
            p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
            lang, score, rejected = model.predict(text)
            assert abs(score - p[:-1].max()) < 1e-4 and lang == model.labels[int(p[:-1].argmax())] and rejected == bool(p[-1] > model.limit)
        else:
            z = model.table[langid.hashes(points)].mean(axis=0, dtype=np.float64) + model.bias
            assert np.allclose(model.mean_scores(text), z, atol=1e-3)


def test_language_without_labels(spark):
    docs = lang_table(spark).withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(docs)
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}


def test_held_out_languages_are_not_used(spark):
    docs = lang_table(spark)
    turned = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "cc").otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(turned)
    assert a.labels == b.labels and (a.table == b.table).all()
