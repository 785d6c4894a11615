"""The pipeline's stages, each judged on its own input."""

import importlib
import os

import pytest

import corpus_pipeline
from triagelake.llm import decontam, lines, neardup
from triagelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = (docs, out)
        docs = out
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == columns, name
    before, after = seen["language_id"]
    assert after.count() >= 0.98 * before.where("text IS NOT NULL").count()
    before, after = seen["line_dedup"]
    thinned = {r.doc_id: r for r in lines.dedup_lines(before).collect()}
    gone = {d for d, r in thinned.items() if r.n_dropped and not (r.text or "").strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id for r in after.collect()} == set(thinned) - gone and lines.lines_to_drop(after).count() == 0
    before, after = seen["near_dedup"]
    kept = {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == kept
    before, after = seen["decontamination"]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in decontam.find_leaks(before, benchmark).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - leaks
    before, after = seen["packing"]
    assert after.where("piece = 0").count() == before.count()


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, doc string"
    odd = [(1, None, None, None, None, 1, "a"), (2, "", "en", "s", 0, 2, "b"), (None, "words without an id", None, None, None, None, None),
           (3, "some words of a text", "en", "s", 4, 1, "c"), (3, "some words of a text", "en", "s", 4, 1, "c")]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            path = str(tmp_path / f"{len(rows)}-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_line_dedup_keeps_other_columns(spark):
    shared = "a line that two documents share"
    docs = spark.createDataFrame([(1, shared, 77, 88), (2, shared + "\nown", 78, 89), (3, shared, 79, 90), (4, " ", 80, 91)],
                                 "doc_id long, text string, n_lines int, n_dropped int")
    out = corpus_pipeline.line_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, shared, 77, 88), (2, "own", 78, 89), (4, " ", 80, 91)]


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
