"""CSV records of files of any size, read by many tasks.

A quoted field may hold line breaks, so where a record begins depends on all quotes before it. Spark
deals out byte ranges of a file as physical lines. A first pass walks each range twice, as if it began
outside and inside a quoted field, and keeps what state each walk ends in. Chained in file order, one
small row for each range, these give every range its true beginning; a second pass then cuts records.
Pieces of a record that crosses ranges are joined by the line on which it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bits of a position that number the lines of a file; the bits above number the files.
LINE_BITS = 36
_CLOSE = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after a physical line. Quotes count at the beginning of a field only."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line[at:at + 1] == '"':
            closed = _CLOSE.match(line, at if inside else at + 1)
            if not closed:
                return True
            inside, at = False, closed.end()
        at = line.find(",", at) + 1
        if not at:
            return False


@dataclass(frozen=True)
class _Range:
    """What the second pass must know of a byte range."""

    number: int           # of its file
    first: int            # line number of its first line
    inside: bool          # whether it begins in a quoted field
    owner: int            # line on which the record open at its beginning began
    heading: int | None   # line of the file's heading, if that is no record


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, start, some lines in order) of a task's rows; a range may come in several lots."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts, lines = (c.to_pylist() for c in batch.columns)
        begin = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or files[k] != files[begin] or starts[k] != starts[begin]:
                part = lines[begin:k]
                yield files[begin], starts[begin], part
                begin = k


def _without_mark(line: str) -> str:
    return line.removeprefix("﻿")


def _shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its lines, and for both beginnings the state at its end and where the open record began."""
    names = ["file", "start", "lines", "out0", "out1", "open0", "open1", "heading_line", "heading"]
    now, rows = None, []
    for file, start, lines in _ranges(batches):
        if (file, start) != now:
            now = (file, start)
            # -1: the record that is open has begun before this range.
            rows.append([file, start, 0, False, True, -1, -1, None, None])
            first_line, head = start == 0, []
        row = rows[-1]
        for line in lines:
            if first_line:
                line, first_line = _without_mark(line), False
            if row[8] is None and start == 0:
                if head or line.rstrip("\r"):
                    row[7] = row[2] if not head else row[7]
                    head.append(line)
            for side in (0, 1):
                was = row[3 + side]
                if not was:
                    row[5 + side] = row[2]
                row[3 + side] = ends_inside(line, was)
            if head and row[8] is None and not row[3]:
                row[8] = "\n".join(head)
            row[2] += 1
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names)


@dataclass
class Records:
    """``rows``: (position, record) without headings; ``headings``: the text of each file's first record, in file order."""

    rows: DataFrame
    headings: list[str]


def read_records(spark: SparkSession, path: str, one_heading: bool = False) -> Records:
    """The records of a file, or of the files of a folder in order of their paths.

    Records end at a line feed outside quoted fields; a carriage return before it and blank lines go. The
    first record of each file is its heading, or with ``one_heading`` that of the first file alone. A
    field that is never closed takes the rest of its file, less the last line feed. ``position`` is the file's number and the
    number of the record's first line, so it does not depend on how ranges are cut.
    """
    lines = _lines(spark, path)
    shapes = lines.mapInArrow(_shapes, "file string, start long, lines long, out0 boolean, out1 boolean, open0 long, open1 long, "
                              "heading_line long, heading string").collect()
    # One small row for each byte range, whatever the rows in it.
    ranges: dict[tuple[str, int], _Range] = {}
    found: list[tuple[int, int, str | None]] = []
    number, file, inside, owner, line, heading = -1, None, False, 0, 0, None
    for s in sorted(shapes, key=lambda r: (r.file, r.start)):
        if s.file != file:
            number, file, inside, owner, line = number + 1, s.file, False, 0, 0
            heading = None
            if s.heading_line is not None and not (one_heading and found):
                heading = s.heading_line
                found.append((number, heading, s.heading))
        ranges[s.file, s.start] = _Range(number, line, inside, owner, heading)
        opened = s.open1 if inside else s.open0
        owner = line + opened if opened >= 0 else owner
        inside = s.out1 if inside else s.out0
        line += s.lines
    # Broadcasts are pickled by reference to their classes, which a worker without this package on its path cannot load.
    shared = spark.sparkContext.broadcast({key: astuple(r) for key, r in ranges.items()})

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, inside, at, since, owner, parts, whole = None, None, False, 0, 0, 0, [], True
        out: list[tuple[int, int, int, bool, str]] = []

        def closed(complete: bool) -> None:
            text = "\n".join(parts)
            parts.clear()
            if owner == known.heading and not wanted_headings:
                return
            if complete and whole:
                text = text.removesuffix("\r")
                if not text:
                    return
            out.append((known.number, owner, since, complete and whole, text))

        for file, start, lines in _ranges(batches):
            if (file, start) != now:
                if parts:
                    closed(False)
                now, known = (file, start), _Range(*shared.value[file, start])
                inside, at, owner, whole = known.inside, known.first, known.owner, not known.inside
            for line in lines:
                if start == 0 and at == known.first:
                    line = _without_mark(line)
                if not parts:
                    since = at
                    if not inside:
                        owner, whole = at, True
                parts.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    closed(True)
                at += 1
            yield _cut_rows(out)
            out = []
        if parts:
            closed(False)
        yield _cut_rows(out)

    def cut_rows() -> DataFrame:
        pieces = lines.mapInArrow(cut, "number long, owner long, line long, whole boolean, text string")
        crossing = (pieces.where("NOT whole").groupBy("number", "owner").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("parts"))
                    .select("number", "owner", F.regexp_replace(F.array_join(F.col("parts.text"), "\n"), r"\r\z", "").alias("text")))
        return pieces.where("whole").select("number", "owner", "text").unionByName(crossing).select(
            F.shiftleft("number", LINE_BITS).bitwiseOR(F.col("owner")).alias("position"), F.col("text").alias("record"))

    wanted_headings = any(text is None for _, _, text in found)
    if wanted_headings:
        # A heading that crosses ranges is put together like any other record.
        places = {(n << LINE_BITS) | at: k for k, (n, at, _) in enumerate(found)}
        for row in cut_rows().where(F.col("position").isin(list(places))).collect():
            n, at, _ = found[places[row.position]]
            found[places[row.position]] = (n, at, row.record)
        wanted_headings = False
    return Records(cut_rows(), [text.removesuffix("\r") for _, _, text in found])


def _cut_rows(out: list[tuple[int, int, int, bool, str]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["number", "owner", "line", "whole", "text"])
