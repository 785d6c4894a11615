"""Near-duplicate documents by HyperMinHash sketches.

A document is the set of its word shingles, as 64-bit hashes. Each bucket of the sketch keeps the
smallest of its own hash over the set as a leading-zero count and ten mantissa bits. Equal sets fold
into one first. Bands of compressed registers form candidate groups; inside a group the registers
give a Jaccard estimate corrected for accidental matches, and every pair it does not rule out is
verified on the full sets. Groups are cut by set size and into blocks, so no task holds a large one,
and only links that connect something leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from triagelake.llm.common import saved, slices
from triagelake.llm.graph import components

MANTISSA = 10
#: Documents of one block. A task compares two blocks at most.
BLOCK = 64
#: Candidate ids (16 bytes each) up to this count are sent to every task; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Chance that bands miss a pair just at the threshold.
MISS = 1e-8
_CACHE = 300_000


@dataclass(frozen=True)
class Settings:
    """``percent``: links need 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        return 7 if self.percent >= 85 else 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.rows)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lowered; a shorter text is one run."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))
    n = min(words, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _salts(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(42)
    return (random.integers(0, 1 << 32, buckets, np.uint32), random.integers(0, 1 << 32, buckets, np.uint32) | np.uint32(1))


_SALTS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def sketch(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A register per bucket: leading zeros of its smallest hash, then the bits after the first one."""
    if buckets not in _SALTS:
        _SALTS[buckets] = _salts(buckets)
    flip, factor = _SALTS[buckets]
    short = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(buckets, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 128):
        grid = short[at:at + 128, None] ^ flip
        grid *= factor
        np.minimum(least, grid.min(axis=0), out=least)
    wide = least.astype(np.uint64)
    zeros = np.where(least > 0, 31 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))), 32).astype(np.uint64)
    mantissa = (wide << (zeros + np.uint64(1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers."""
    bands = registers.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(len(bands), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        keys = (keys ^ bands[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two disjoint sets of these sizes agree."""
    low = np.concatenate([(1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) * 2.0 ** -(z + 1) for z in range(32)])
    width = np.repeat(2.0 ** -(np.arange(32) + 1 + MANTISSA), 1 << MANTISSA)

    def mass(sizes: np.ndarray) -> dict[int, np.ndarray]:
        # Cells as probabilities that the smallest of s uniform hashes falls into them.
        return {int(s): np.exp(s * np.log1p(-np.minimum(low, 1 - 1e-12))) - np.exp(s * np.log1p(-np.minimum(low + width, 1 - 1e-12)))
                for s in np.unique(sizes)}

    rounded = [np.maximum(1, 2 ** np.round(np.log2(np.maximum(x, 1)))).astype(np.int64) for x in (n, m)]
    cells = mass(np.concatenate(rounded))
    pairs = {(a, b): float(cells[int(a)] @ cells[int(b)]) for a in np.unique(rounded[0]) for b in np.unique(rounded[1])}
    return np.array([[pairs[a, b] for b in rounded[1]] for a in rounded[0]])


def estimates(registers: list[np.ndarray], other: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard of every pair from matching registers, less the matches that chance gives."""
    left, right = np.stack(registers), np.stack(other)
    same = np.stack([(right == row).mean(axis=1) for row in left])
    chance = accidental(n, m)
    return (same - chance) / (1 - chance)


def signatures(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, d1, d2, keys) of every row: set size, 128-bit digest of the set, band keys."""
    buckets, rows = settings.bands * settings.rows, settings.rows

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            n, d1, d2, keys = [], [], [], []
            for text in texts:
                own = shingles(text, settings.words)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                n.append(len(own))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(band_keys(sketch(own, buckets), rows).view(np.int64) if len(own) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))], ["doc", "n", "d1", "d2", "keys"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(sign, "doc long, n long, d1 long, d2 long, keys array<long>")


def linked(sets: list[np.ndarray], settings: Settings, split: int | None = None) -> np.ndarray:
    """Which pairs reach the threshold on their full sets; with ``split``, only pairs across it."""
    n = np.array([len(s) for s in sets])
    ratio = settings.percent / 100
    fit = (np.minimum.outer(n, n) >= np.maximum(ratio * np.maximum.outer(n, n) - 1e-9, 1)) & ~np.eye(len(n), dtype=bool)
    if split is not None:
        side = np.arange(len(n)) < split
        fit &= side[:, None] != side
    if not fit.any():
        return fit
    registers = [sketch(s, settings.bands * settings.rows) for s in sets]
    # Seven standard errors below the threshold: a pair ruled out here is not one.
    floor = ratio - 7 * math.sqrt(ratio * (1 - ratio) / len(registers[0]))
    fit &= estimates(registers, registers, n, n) >= floor
    rows = np.flatnonzero(fit.any(axis=1))
    if not len(rows):
        return fit
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), n[rows])
    order = np.argsort(flat, kind="stable")
    token = np.cumsum(np.concatenate([[0], np.diff(flat[order]) != 0]))
    owner = owner[order]
    shared = np.bincount(token)[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(rows), len(rows)))
    width = max(1, 4_000_000 // len(rows))
    for at in range(0, int(token.max()) + 1 if len(token) else 0, width):
        here = (token >= at) & (token < at + width)
        grid = np.zeros((len(rows), min(width, int(token.max()) + 1 - at)), np.float32)
        grid[owner[here], token[here] - at] = 1
        both += grid @ grid.T
    out = np.zeros_like(fit)
    union = n[rows][:, None] + n[rows] - both
    out[np.ix_(rows, rows)] = 100 * both >= settings.percent * union
    return out & fit


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links (first member, member) that connect what ``adjacent`` connects."""
    seen, out = np.zeros(len(adjacent), bool), []
    for start in range(len(adjacent)):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            reached = np.flatnonzero(adjacent[front].any(axis=0) & ~seen)
            seen[reached] = True
            out += [(start, int(r)) for r in reached]
            front = list(reached)
    return out


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(node, component) of the documents (doc, keys) that share a band with another one."""
    bands = reps.select("doc", F.explode("keys").alias("key"))
    hubs = saved(bands.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").select("key", "hub"))
    return components(bands.join(hubs, "key").where("doc > hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())


def verified_links(docs: DataFrame, groups: DataFrame, settings: Settings, id_col: str, text_col: str,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Links (a, b) that connect the documents of each candidate group as the threshold does.

    Sets of linked documents differ in size by the threshold at most, so a document meets those of its
    own size cell and of the next one, block by block.
    """
    step = math.log(100 / settings.percent)
    wanted = groups.select(F.col("node").alias("__llm_node"), F.col("component").alias("__llm_group"))
    if groups.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(wanted, F.col("doc") == F.col("__llm_node"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, group in slices(batches):
            sets = [shingles(t, settings.words) for t in texts]
            cell = [int(math.log(max(len(s), 1)) / step + 1e-9) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(group, pa.int64()), pa.array(cell, pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc", "group", "cell", "hashes"])

    sets = saved(rows.select("doc", "text", "__llm_group").mapInArrow(read, "doc long, group long, cell int, hashes binary"))
    cells = sets.groupBy("group", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = cells.select("group", "cell", "blocks")
    above = cells.select("group", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("above"))
    below = cells.select("group", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("below"))
    shape = saved(own.join(above, ["group", "cell"], "left").join(below, ["group", "cell"], "left").na.fill(0))
    placed = sets.join(shape, ["group", "cell"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # The tasks a document is in: its block with each block of its cell, of the next one and of the one before.
    within = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.col("cell").alias("low"), F.least("block", k).alias("i"), F.lit(0).alias("up"), F.greatest("block", k).alias("j"), F.lit(0).alias("side")))
    none = F.filter(within, lambda _: F.lit(False))
    up = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: F.struct(
        F.col("cell").alias("low"), F.col("block").alias("i"), F.lit(1).alias("up"), k.alias("j"), F.lit(0).alias("side")))).otherwise(none)
    down = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda k: F.struct(
        (F.col("cell") - 1).alias("low"), k.alias("i"), F.lit(1).alias("up"), F.col("block").alias("j"), F.lit(1).alias("side")))).otherwise(none)
    tasks = placed.withColumn("task", F.explode(F.concat(within, up, down))).select("doc", "hashes", "group", "task.*")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "doc"], kind="stable")
        ids = pdf["doc"].to_numpy()
        sets_ = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
        split = int((pdf["side"] == 0).sum()) if int(pdf["up"].iloc[0]) else None
        pairs = spanning(linked(sets_, settings, split)) if len(ids) > 1 else []
        return pd.DataFrame({"a": [ids[x] for x, _ in pairs], "b": [ids[y] for _, y in pairs]}, dtype="int64")

    return tasks.groupBy("group", "low", "i", "up", "j").applyInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A document without words, or a null text, has an empty set and is linked with nothing. Rows of
    one id and one set are one document; repeated rows come out repeated. A null id is linked with
    nothing, its component is null and it is kept. Texts are read whole. Other columns are not
    carried; an empty table gives no rows.
    """
    signed = saved(signatures(docs, settings, id_col, text_col))
    some = signed.where("n > 0 AND doc IS NOT NULL")
    classes = saved(some.groupBy("d1", "d2", "n").agg(F.min("doc").alias("rep")))
    reps = saved(some.join(classes, ["d1", "d2", "n"]).where("doc = rep").dropDuplicates(["doc", "d1", "d2"]).select("doc", "keys"))
    links = saved(verified_links(docs, saved(candidate_groups(reps)), settings, id_col, text_col))
    joined = saved(components(links))
    named = saved(classes.join(joined, F.col("rep") == F.col("node"), "left")
                  .select("d1", "d2", "n", F.coalesce("component", "rep").alias("component")))
    return (signed.select("doc", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
            .withColumn("component", F.when(F.col("n") == 0, F.col("doc")).when(F.col("doc").isNotNull(), F.coalesce("component", "doc")))
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                    F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept")))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less those in the component of a smaller id. Null ids stay."""
    gone = near_duplicates(docs, settings, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__llm_doc")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__llm_doc"), "left_anti")
