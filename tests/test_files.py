import csv
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from triagelake.sources import csvlines, files, sinks
from triagelake.sources.contracts import ContractError, output_row_errors
from triagelake.sources.files import read_strict_csv

HEADER = "message_id,user_id,conversation_type,group_id,business_id,sender_user_id,created_at,message_text,media_type,media_id,forwarded_count\n"


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_csv_reads_quotes_newlines_bom_and_short_records(spark, tmp_path):
    path = _write(tmp_path, "m.csv", "﻿ Message_ID ,Text,N\na,\"two\nlines, \"\"quoted\"\"\",1\nb,,2\nc,short\n")
    rows = files.read_strict_csv(spark, path, ["message_id", "n"]).orderBy("position").collect()
    assert [(r["message_id"], r["text"], r["n"]) for r in rows] == [("a", 'two\nlines, "quoted"', "1"), ("b", "", "2"), ("c", "short", "")]


@pytest.mark.parametrize("text, problem", [("a,a\n1,2\n", "duplicate header"), ("a,\n1,2\n", "empty header"), ("b\n1\n", "missing headers")])
def test_header_errors(spark, tmp_path, text, problem):
    with pytest.raises(ContractError, match=problem):
        files.read_strict_csv(spark, _write(tmp_path, "h.csv", text), ["a"])


def test_surplus_cells_raise(spark, tmp_path):
    with pytest.raises(Exception, match="more cells"):
        files.read_strict_csv(spark, _write(tmp_path, "s.csv", "a,b\n1,2,3\n"), ["a"]).collect()


def test_typed_table_quarantine_and_uniqueness(spark, tmp_path):
    row = "{},u1,personal,,,u2,2026-07-30 22:19,hello,,,{}\n"
    good = _write(tmp_path, "good.csv", HEADER + row.format("m1", "0") + row.format("m2", "3"))
    first = files.read_table(spark, good, "messages").orderBy("position").head()
    assert (first["group_id"], first["forwarded_count"], first["created_at"].minute) == (None, 0, 19)
    bad = _write(tmp_path, "bad.csv", HEADER + row.format("m1", "x") + row.format("", "1"))
    with pytest.raises(ContractError):
        files.read_table(spark, bad, "messages")
    errors = [r["_errors"] for r in files.read_table(spark, bad, "messages", quarantine=True).orderBy("position").collect()]
    assert errors == [["forwarded_count: not a valid int"], ["message_id: blank"]]
    with pytest.raises(ContractError, match="duplicate key"):
        files.read_table(spark, _write(tmp_path, "dup.csv", HEADER + row.format("m1", "0") * 2), "messages")


def test_predictions_reader(spark, tmp_path):
    head = "message_id,action,message_type,reason,confidence,evidence_message_ids\n"
    rows = files.read_predictions(spark, _write(tmp_path, "p.csv", head + "a,NOTIFY,scam,why,0.5,x;y\n")).collect()
    assert (rows[0]["action"], rows[0]["confidence"]) == ("notify", 0.5)
    for bad in ("a,notify,scam,why,1.5,none\n", "a,notify,scam,why,0.5,x;;y\n", "a,notify,scam,,0.5,none\n"):
        with pytest.raises(ContractError):
            files.read_predictions(spark, _write(tmp_path, "b.csv", head + bad))


def test_media_manifest_presence_and_escape(spark, tmp_path):
    root = tmp_path / "dataset"
    (root / "media").mkdir(parents=True)
    (root / "media" / "a.png").write_bytes(b"abc")
    (tmp_path / "out.png").write_bytes(b"x")
    images = spark.createDataFrame([("i1", "media/a.png"), ("i2", "dataset/media/a.png"), ("i3", "../out.png"), ("i4", "media/none.png")], "image_id string, file_path string")
    voices = spark.createDataFrame([], "voice_note_id string, file_path string")
    got = {r["media_id"]: (r["file_exists"], r["file_size_bytes"]) for r in files.media_manifest(spark, images, voices, str(root)).collect()}
    assert got == {"i1": (True, 3), "i2": (True, 3), "i3": (False, None), "i4": (False, None)}


def test_media_files_are_read_in_chunks_and_only_if_named(spark, tmp_path):
    root = tmp_path / "data set#1"
    (root / "media" / "deep er").mkdir(parents=True)
    zeros = (1 << 31) + 5  # above the limit of one value; sparse on disk
    for name in ("large.wav", "unnamed.wav"):
        with open(root / "media" / name, "wb") as file:
            file.truncate(zeros)
    body = os.urandom(3 << 20)
    (root / "media" / "deep er" / "50%.gz").write_bytes(gzip.compress(body))
    (root / "media" / "none.png").write_bytes(b"")
    (root / "beside.png").write_bytes(b"x")
    images = spark.createDataFrame(
        [("i1", "media/deep er/50%.gz"), ("i2", "./media/./deep er/50%.gz"), ("i3", "media/none.png"), ("i4", "media/deep er"), ("i5", "beside.png"), ("i6", None), ("i7", "")],
        "image_id string, file_path string")
    voices = spark.createDataFrame([("v1", "media/large.wav"), ("v1", "media/large.wav")], "voice_note_id string, file_path string")
    got = {r["media_id"]: (r["file_exists"], r["file_size_bytes"], r["sha256"]) for r in files.media_manifest(spark, images, voices, str(root), "media").collect()}
    large = hashlib.sha256()
    for _ in range(1 << 7):
        large.update(bytes(1 << 24))
    large.update(bytes(5))
    packed = (root / "media" / "deep er" / "50%.gz").read_bytes()
    there = (True, len(packed), hashlib.sha256(packed).hexdigest())
    absent = (False, None, None)
    assert got == {"i1": there, "i2": there, "i3": (True, 0, hashlib.sha256(b"").hexdigest()), "i4": absent, "i5": absent,
                   "i6": absent, "i7": absent, "v1": (True, zeros, large.hexdigest())}
    nothing = images.limit(0)
    assert files.media_manifest(spark, nothing, voices.limit(0), str(tmp_path / "no such folder")).count() == 0
    assert [r["file_exists"] for r in files.media_manifest(spark, images.limit(1), voices.limit(0), str(tmp_path / "no such folder")).collect()] == [False]


def test_traces_skip_broken_records_and_filter_versions(spark, tmp_path):
    path = _write(tmp_path, "t.json", '{"message_id":"a","prompt_version":"p1"}\n{"message_id":\n{"message_id":"b","prompt_version":"p2"}\n')
    schema = "message_id string, prompt_version string"
    assert files.read_traces(spark, path, schema).count() == 2
    assert [r[0] for r in files.read_traces(spark, path, schema, "p2").collect()] == ["b"]


def _final(spark, ids):
    return spark.createDataFrame([(i, "digest", "payment", "one\r\ntwo\n", 0.5, ["h1", "h2"] if i == "b" else []) for i in ids],
                                 "message_id string, action string, message_type string, reason string, confidence double, evidence_ids array<string>")


HEADING = "message_id,action,message_type,reason,confidence,evidence_message_ids"


def test_contract_csv_keeps_template_order(spark, tmp_path):
    template = spark.createDataFrame([("b", 0), ("a", 1)], "message_id string, position long")
    out = str(tmp_path / "out")
    sinks.write_contract_csv(_final(spark, ["a", "b"]), template, out)
    rows = files.read_output_rows(spark, out, in_parts=True).collect()
    assert sorted((r["line_number"], r["message_id"], r["reason"], r["confidence"], r["evidence_message_ids"]) for r in rows) == [
        (2, "b", "one two", "0.50", "h1;h2"), (3, "a", "one two", "0.50", "none")]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert text == f"{HEADING}\nb,digest,payment,one two,0.50,h1;h2\na,digest,payment,one two,0.50,none\n"
    for ids, problem in ((["a", "zz"], "unexpected"), (["a", "a"], "duplicate")):
        with pytest.raises(ContractError, match=problem):
            sinks.write_contract_csv(_final(spark, ids), template, str(tmp_path / "bad"))


def test_contract_csv_of_many_parts_has_one_heading(spark, tmp_path):
    ids = [f"m{k:05d}" for k in range(4000)]
    template = spark.createDataFrame([(i, k) for k, i in enumerate(reversed(ids))], "message_id string, position long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_contract_csv(_final(spark, ids), template, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert len(parts) > 1 and lines[0] == HEADING and [x.split(",")[0] for x in lines[1:]] == ids[::-1]
    rows = files.read_output_rows(spark, str(tmp_path / "out"), in_parts=True)
    assert [r["message_id"] for r in rows.orderBy("line_number").collect()] == ids[::-1]


def test_rows_of_several_files_keep_file_order(spark, tmp_path):
    folder = tmp_path / "users"
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n" + "a0,1\na1,2\n")
    (folder / "b.csv").write_text("id,v\n" + "".join(f"b{k},{'x' * 200}\n" for k in range(5000)))
    (folder / "c.csv").write_text("id,v\nc0,9\n")
    got = [r["id"] for r in files.read_strict_csv(spark, str(folder), ["id"]).orderBy("position").collect()]
    assert got == ["a0", "a1"] + [f"b{k}" for k in range(5000)] + ["c0"]
    (folder / "d.csv").write_text("v,id\n1,d0\n")
    with pytest.raises(ContractError, match="headers differ"):
        files.read_strict_csv(spark, str(folder), ["id"])


def test_file_faults_are_reported(spark, tmp_path):
    turned = _write(tmp_path, "o.csv", "action,message_id,message_type,reason,confidence,evidence_message_ids\nmute,a,spam,r,0.5,none,extra\nmute,b,spam,r,0.5,none\n")
    rows = files.read_output_rows(spark, turned)
    known = spark.createDataFrame([("a",), ("b",)], "message_id string")
    got = {r["line_number"]: r["errors"] for r in output_row_errors(rows, known, known).collect()}
    assert got == {2: ["column order mismatch", "more cells than headers"], 3: ["column order mismatch"]}


def test_output_contract_lists_every_broken_rule(spark):
    rows = spark.createDataFrame([
        (2, "a", "interrupt", "payment", "x\ny", "nan", "zz"), (3, "b", "notify", "payment", "fine", "0.5", "h1")],
        "line_number long, message_id string, action string, message_type string, reason string, confidence string, evidence_message_ids string")
    known = spark.createDataFrame([("a",), ("b",)], "message_id string")
    got = {r["message_id"]: r["errors"] for r in output_row_errors(rows, known, spark.createDataFrame([("h1",)], "message_id string")).collect()}
    assert got["a"] == ["embedded newline in reason", "invalid action", "reason must be a single line", "confidence outside [0, 1]", "unresolved evidence ids"]
    assert got["b"] == []


def test_resume_store_newest_row_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    for batch, mark in ((1, "old"), (2, "new")):
        sinks.append_completed(spark.createDataFrame([("a", "f1", mark)], "message_id string, fingerprint string, row string"), path, batch)
    done = sinks.read_completed(spark, path)
    assert done.head()["row"] == "new"
    planned = spark.createDataFrame([("a", "f1"), ("b", "f2")], "message_id string, fingerprint string")
    reused, left = sinks.split_resumable(planned, done)
    assert [r["message_id"] for r in reused.collect()] == ["a"] and [r["message_id"] for r in left.collect()] == ["b"]


def _records_of(text):
    """Records by a plain walk over all characters: (line of the first character, text)."""
    out, start, line, now, quoted, field_start = [], 0, 0, "", False, True
    k = 0
    while k < len(text):
        c = text[k]
        if quoted:
            now += c
            line += c == "\n"
            if c == '"':
                if text[k + 1:k + 2] == '"':
                    now, k = now + '"', k + 1
                else:
                    quoted = False
        elif c == "\n":
            out.append((start, now.removesuffix("\r")))
            line, now, field_start = line + 1, "", True
            start = line
        else:
            quoted = c == '"' and field_start
            field_start = c == ","
            now += c
        k += 1
    return [(s, r) for s, r in out + [(start, now.removesuffix("\r"))] if r]


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_records_are_the_same_however_ranges_are_cut(spark, tmp_path, size):
    noise = random.Random(size)
    texts = ["".join(noise.choice(['"', '"', ",", "\n", "\r\n", "a", "é b", '""', "x" * 9]) for _ in range(120)) + "z" for _ in range(6)]
    texts += ['h1,h2\n"one\n\n\n\n\n\n\n\n\n\n\n\n\n\n\nlong field",2\n3,4\n\n5,"6"', '"head\ning",b\n1,2', "﻿a,b\n1,2\n", '"a","never closed\n1\n2']
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for k, text in enumerate(texts):
            path = tmp_path / f"{k}.csv"
            path.write_bytes(text.encode())
            found = csvlines.read_records(spark, str(path))
            expected = _records_of(text.removeprefix("﻿"))
            assert found.headings == [r for _, r in expected[:1]]
            assert sorted(map(tuple, found.rows.collect())) == expected[1:]
            if size == 7:
                assert csvlines._lines(spark, str(path)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [(f"m{k}", f'text {k}\nwith, a "break"' if k % 3 else "plain") for k in range(5000)]
    path = tmp_path / "big.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerows([("message_id", "text"), *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_strict_csv(spark, str(path), ["message_id", "text"])
        many = [tuple(r) for r in read.orderBy("position").collect()]
        assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[:2] for r in many] == rows
    assert many == [tuple(r) for r in read_strict_csv(spark, str(path), ["message_id", "text"]).orderBy("position").collect()]


def test_folders_with_partition_names_and_equal_file_names(spark, tmp_path):
    for day in (1, 2):
        folder = tmp_path / f"day={day}"
        folder.mkdir()
        (folder / "part.csv").write_text(f'a,b\n{day},"x\ny"\n')
    rows = read_strict_csv(spark, str(tmp_path), ["a", "b"]).orderBy("position").collect()
    assert [tuple(r)[:2] for r in rows] == [("1", "x\ny"), ("2", "x\ny")]


def test_store_stays_small_over_many_batches(spark, tmp_path):
    path, expected = str(tmp_path / "store"), {}
    for batch in range(1, 21):
        rows = [(f"m{k:03}", f"f{batch}", f"{batch}") for k in range(batch % 5, 60, 1 + batch % 4)]
        expected |= {m: (f, r) for m, f, r in rows}
        sinks.append_completed(spark.createDataFrame(rows, "message_id string, fingerprint string, row string").coalesce(1), path, batch, compact_every=4)
        if batch in (3, 4, 5, 20):
            assert {r.message_id: (r.fingerprint, r.row) for r in sinks.read_completed(spark, path).collect()} == expected
    stored = sinks._stored(spark, path)
    assert stored.count() <= 60 + 3 * 60
    # Of one id only the files whose range holds it are read: ids lie sorted in the compacted part.
    base = spark.read.parquet(f"{path}/_compacted/upto={sinks._compacted(spark, path)}")
    spans = base.groupBy(F.input_file_name()).agg(F.min("message_id").alias("lo"), F.max("message_id").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_torn_compaction_does_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda mark: spark.createDataFrame([("a", "f", mark), ("b", "f", mark)], "message_id string, fingerprint string, row string")
    for batch in (1, 2):
        sinks.append_completed(rows(str(batch)), path, batch)
    torn = tmp_path / "store" / "_compacted" / "upto=2"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"torn")
    assert {r.row for r in sinks.read_completed(spark, path).collect()} == {"2"}
    sinks.compact_completed(spark, path)
    sinks.append_completed(rows("3"), path, 3)
    assert {r.row for r in sinks.read_completed(spark, path).collect()} == {"3"} and sinks._stored(spark, path).count() == 4


def test_failed_output_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "traces")
    good = spark.createDataFrame([("m1",)], "message_id string").select(
        "message_id", F.lit("mute").alias("action"), F.lit("spam").alias("message_type"), F.lit("x").alias("reason"), F.lit(0.5).alias("confidence"),
        F.array().cast("array<string>").alias("evidence_ids"), F.array().cast("array<string>").alias("rules_fired"), F.struct(F.lit(1).alias("n")).alias("gate_trace"))
    sinks.write_traces(good, path, "p1")
    bad = good.withColumn("action", F.raise_error(F.lit("broken row")).cast("string"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_traces(bad, path, "p2")
    assert [r.prompt_version for r in spark.read.json(path).collect()] == ["p1"] and [p.name for p in tmp_path.iterdir()] == ["traces"]
    sinks.write_traces(good, path, "p3")
    assert [r.prompt_version for r in spark.read.json(path).collect()] == ["p3"] and [p.name for p in tmp_path.iterdir()] == ["traces"]


def test_tables_are_read_side_by_side(spark):
    """Independent steps overlap, keep their order and raise the first error in order."""
    import threading

    from triagelake.session import at_once

    meet = threading.Barrier(2, timeout=60)
    assert at_once([lambda k=k: (meet.wait(), spark.range(k).count())[1] for k in (3, 5)]) == [3, 5]
    with pytest.raises(ValueError, match="first"):
        at_once([lambda: 1, lambda: int("first"), lambda: int("second")])


def test_ranges_travel_without_the_package(spark, tmp_path, monkeypatch):
    """A worker that cannot import this package can still load what is broadcast."""
    import pickle

    from triagelake.sources.csvlines import read_records

    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(pickle.dumps(value)), broadcast(self, value))[1])
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    assert [r.record for r in read_records(spark, str(tmp_path / "a.csv")).rows.collect()] == ['1,"two\nlines"']
    assert sent and not any(b"triagelake" in value for value in sent)


def test_a_table_is_cut_and_typed_once(spark, tmp_path):
    """What the contract is checked on, and what a run reads again, is no longer the text."""
    path = _write(tmp_path, "e.csv", ",".join(files.TABLES["message_events"]) + "\nu1,m1,Yes,no,1.5,0,fal\u017fe,TRUE\nu1,m2,1,No,,yes,false,0\n")
    rows = files.read_table(spark, path, "message_events")
    plan = rows._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "from_csv" not in plan
    assert [tuple(r)[2:8] for r in rows.orderBy("position").collect()] == [(True, False, 1.5, False, False, True), (True, False, None, True, False, False)]


def test_boolean_words_are_folded_like_in_python(spark):
    from triagelake.functions.vocab import boolean_word

    words = [w for b in ("true", "1", "yes", "false", "0", "no", "ye", "falsse", "st") for w in (b, b.upper(), f" {b} ", b.replace("s", "\u017f"), b.replace("ss", "\u00df"), b + "\u212a")]
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", boolean_word(F.col("w")).alias("b"))
    assert "EvalPython" not in rows._jdf.queryExecution().toString()
    of = {**dict.fromkeys(("true", "1", "yes"), True), **dict.fromkeys(("false", "0", "no"), False)}
    assert [(r.w, r.b) for r in rows.collect()] == [(w, w and of.get(w.strip(" ").casefold())) for w in [*words, None]]
