"""Line dedup: two Bloom filters choose the suspects, only suspects shuffle for exact confirmation.

A line's key is the line without white space (\\x20, \\x09-\\x0D) at both ends and with A-Z lowered.
Each task puts the keys of its documents into a filter of those seen once; what that knows already goes
into the filter of those seen twice. The tasks' filters are merged segment by segment, and a bit that
two tasks have once is there twice. Lines whose bits are all in the merged second filter are suspects;
they alone are shuffled with their full keys, so a false alarm costs a row and never a wrong result.

The filters are as large as the lines ask for, and are sent to every task up to a stated size. Beyond
it hashes are dealt out by range, each task filters its own range, and the suspects are found by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from triagelake.llm.common import SPACE, saved, slices

MIN_CHARS = 10
#: Suspected hashes (8 bytes each) up to this count are sent to every task; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bits of a filter for each line, bits that a hash sets, and the largest filter that every task gets.
BITS, PROBES, SENT_BITS = 24, 2, 1 << 28
#: Bits of a segment, in which tasks hand on their filters.
SEGMENT = 1 << 16
#: Places that a task gathers before it sorts them in.
HELD = 1 << 20
_WS = SPACE.encode()


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of every line long enough to count."""
    for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(_WS).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            yield number, key


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def filter_bits(docs: DataFrame, text_col: str = "text") -> int:
    """Room for every line of the documents, in whole segments."""
    lines = docs.agg(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0]
    return -(-max(1, lines or 0) * BITS // SEGMENT) * SEGMENT


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row of PROBES places."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    turned = [(hashes + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) for k in range(PROBES)]
    # The upper half of a hash times the number of bits, so that any number will do.
    return np.stack([((t >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64) for t in turned], axis=1)


def _own_filters(bits: int):
    """Of a task's documents, the places seen once and those seen twice, by segment."""
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted places; what a task holds follows its own lines, not the size of the filter.
        once, twice, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge() -> None:
            nonlocal once, twice, held
            place, count = np.unique(np.concatenate([once, *waiting]), return_counts=True)
            once, twice = place, np.union1d(twice, place[count > 1])
            waiting.clear()
            held = 0

        for ids, texts in slices(batches, 1024):
            for doc, text in zip(ids, texts):
                if doc is not None:
                    own = np.array(list({xxhash.xxh3_64_intdigest(key) for _, key in line_keys(text)}), np.uint64)
                    waiting.append(_places(own, bits).reshape(-1))
                    held += PROBES * len(own)
            if held > HELD:
                merge()
        merge()
        bounds = np.arange(0, bits + SEGMENT, SEGMENT)
        first, second = np.searchsorted(once, bounds), np.searchsorted(twice, bounds)
        rows = [(k, (once[first[k]:first[k + 1]] - bounds[k]).astype("<u2").tobytes(), (twice[second[k]:second[k + 1]] - bounds[k]).astype("<u2").tobytes())
                for k in np.flatnonzero(np.diff(first)).tolist()]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), (pa.int64(), pa.binary(), pa.binary()))],
                                             ["segment", "once", "twice"])

    return build


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter's bits of each segment; rows come sorted by segment."""
    now, tasks, again = None, np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, bool)

    def row() -> pa.RecordBatch:
        bits = np.packbits(again | (tasks > 1)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits], pa.binary())], ["segment", "bits"])

    for segments, once, twice in slices(batches, 16):
        for segment, first, second in zip(segments, once, twice):
            if segment != now:
                if now is not None:
                    yield row()
                now, tasks, again = segment, np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, bool)
            own = np.frombuffer(first, "<u2")
            tasks[own] = np.minimum(tasks[own], 1) + 1
            again[np.frombuffer(second, "<u2")] = True
    if now is not None:
        yield row()


def twice_seen(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The merged filter of hashes seen twice, packed; ``bits`` is SENT_BITS at most."""
    own = docs.select(id_col, text_col).mapInArrow(_own_filters(bits), "segment long, once binary, twice binary")
    rows = own.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment long, bits binary").toArrow()
    out = np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8)
    for segment, packed in zip(rows.column("segment").to_pylist(), rows.column("bits").to_pylist()):
        out[segment] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1)


def _known_twice(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = _places(hashes, 8 * len(packed))
    return ((packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


class _Filter:
    """A Bloom filter that grows by layers, each with twice the room of the one before."""

    PROBES, BITS = 4, 12

    def __init__(self, room: int = 1 << 16):
        self.room, self.layers = room, []
        self._grow()

    def _grow(self) -> None:
        bits = 1 << (self.room * self.BITS - 1).bit_length()
        self.layers.append([np.zeros(bits >> 3, np.uint8), bits - 1, 0, self.room])
        self.room *= 2

    @classmethod
    def _places(cls, hashes: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for probe in range(cls.PROBES):
            place = (hashes + np.uint64(probe) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & np.uint64(mask)
            yield place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for bits, mask, _, _ in self.layers:
            hit = np.ones(len(hashes), bool)
            for place, bit in self._places(hashes, mask):
                hit &= (bits[place] & bit) != 0
            found |= hit
        return found

    def add(self, hashes: np.ndarray) -> None:
        while self.layers[-1][2] + len(hashes) > self.layers[-1][3]:
            self._grow()
        layer = self.layers[-1]
        for place, bit in self._places(hashes, layer[1]):
            np.bitwise_or.at(layer[0], place, bit)
        layer[2] += len(hashes)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key and slice of documents; ``many`` if two documents of the slice hold it."""
    for ids, texts in slices(batches, 1024):
        first: dict[int, int] = {}
        many: set[int] = set()
        for doc, text in zip(ids, texts):
            if doc is None:
                continue
            for _, key in line_keys(text):
                h = xxhash.xxh3_64_intdigest(key)
                if first.setdefault(h, doc) != doc:
                    many.add(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(_signed, first), pa.int64()), pa.array([h in many for h in first], pa.bool_())], ["h", "many"])


def _second_sightings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that the filter of those seen before knows, at every such sighting."""
    once = _Filter()
    for batch in batches:
        hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        many = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        if not len(hashes):
            continue
        unique, where, count = np.unique(hashes, return_inverse=True, return_counts=True)
        again = (count > 1) | (np.bincount(where, weights=many, minlength=len(unique)) > 0)
        seen = once.has(unique)
        once.add(unique[~seen])
        yield pa.RecordBatch.from_arrays([pa.array(unique[again | seen].view(np.int64))], ["h"])


def suspected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hashes of keys that two documents may hold: every true one, and few others."""
    marks = docs.select(id_col, text_col).mapInArrow(_fingerprints, "h long, many boolean")
    return marks.repartition("h").mapInArrow(_second_sightings, "h long").distinct()


def _keyed_lines(packed):
    """Lines with their keys: all of them, or those that the broadcast filter suspects."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            rows = [(doc, number, xxhash.xxh3_64_intdigest(key), key)
                    for doc, text in zip(ids, texts) if doc is not None for number, key in line_keys(text)]
            hashes = np.array([r[2] for r in rows], np.uint64)
            if packed is not None and len(rows):
                kept = np.flatnonzero(_known_twice(packed.value, hashes))
                rows, hashes = [rows[k] for k in kept], hashes[kept]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(hashes.view(np.int64)), pa.array(columns[3], pa.binary())],
                ["doc", "line", "h", "key"])

    return read


def suspected_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
                    sent_bits: int = SENT_BITS) -> DataFrame:
    """(doc, line, h, key) of every line that two documents may hold."""
    rows, schema = docs.select(F.col(id_col).cast("long"), text_col), "doc long, line int, h long, key binary"
    bits = filter_bits(docs, text_col)
    if bits <= sent_bits:
        packed = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, id_col, text_col))
        return rows.mapInArrow(_keyed_lines(packed), schema)
    hashes = saved(suspected(docs, id_col, text_col))
    if hashes.count() <= broadcast_rows:
        hashes = F.broadcast(hashes)
    return rows.mapInArrow(_keyed_lines(None), schema).join(hashes, "h", "left_semi").select("doc", "line", "h", "key")


def lines_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
                  sent_bits: int = SENT_BITS) -> DataFrame:
    """(doc, drop): the numbers of the lines each document loses."""
    held = suspected_lines(docs, id_col, text_col, broadcast_rows, sent_bits)
    repeated = saved(
        held.groupBy("h", "key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"))
    return (held.join(repeated, ["h", "key"]).where("doc > first")
            .groupBy("doc").agg(F.collect_set("line").alias("drop")))


@F.pandas_udf(StringType())
def _left(texts: pd.Series, drops: pd.Series) -> pd.Series:
    """Texts without the lines of those numbers."""
    out = []
    for text, drop in zip(texts, drops):
        if text is not None and drop is not None:
            gone = set(drop)
            text = "\n".join(line for number, line in enumerate(text.split("\n")) if number not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def thinned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
            sent_bits: int = SENT_BITS) -> DataFrame:
    """All columns of ``docs`` with the text thinned, and ``__llm_lines``, ``__llm_dropped``: lines before, lines dropped."""
    drop = lines_to_drop(docs, id_col, text_col, broadcast_rows, sent_bits).select(
        F.col("doc").alias("__llm_doc"), F.col("drop").alias("__llm_drop"))
    text, touched = F.col(text_col), F.col("__llm_drop").isNotNull()
    return (docs.join(drop, F.col(id_col).cast("long") == F.col("__llm_doc"), "left")
            .withColumns({
                "__llm_lines": F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long"),
                "__llm_dropped": F.coalesce(F.size("__llm_drop"), F.lit(0)).cast("long"),
                text_col: F.when(touched, _left(F.when(touched, text), F.col("__llm_drop"))).otherwise(text)})
            .drop("__llm_doc", "__llm_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
                sent_bits: int = SENT_BITS) -> DataFrame:
    """All columns of ``docs`` with the text thinned, and ``n_lines``, ``n_dropped`` added.

    A line goes if its key (10 code points or more) is in two documents and this is not the one with
    the smallest id. A null text counts as one empty line and stays null. Rows of one id are one
    document: repeats inside it stay. A document without an id keeps all lines and makes none repeat.
    Texts are read whole, in time that grows with their length. Added columns replace columns of the same
    names. An empty table gives an empty table.
    """
    found = thinned(docs.drop("n_lines", "n_dropped"), id_col, text_col, broadcast_rows, sent_bits)
    return found.withColumnsRenamed({"__llm_lines": "n_lines", "__llm_dropped": "n_dropped"})
