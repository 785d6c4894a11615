"""Benchmark decontamination: BM25 over test items with block-max bounds, then an overlap check.

The index is of the test items; training passages are the queries. Items fall into classes by their
length, a document is read in half-overlapping windows of twice the class's length, so a leaked item
always lies whole in one window. Postings are kept by block of items with the block's best impact. An
item's most frequent terms together cannot reach its threshold; they have no postings, and the rest
must bring what they leave open. A window whose terms' peaks cannot bring that is passed over; in the
others, block-max WAND moves cursors over the postings, skips to the pivot and scores a block only if its
best impacts could bring that for one of its items. Every item that scores its threshold, a share of the score of its own text,
is verified by the overlap of its question and its answer with the window's runs of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triagelake.llm.common import SLICE, saved, slices

K1, B = 1.2, 0.75
SHARE, OVERLAP, RUN = 0.6, 0.5, 3
BLOCK = 8
#: Most of its threshold that an item's frequent terms may bring without postings.
OPEN = 0.5
#: Items and characters of one index, which every task gets; a larger benchmark makes several.
INDEX_ITEMS, INDEX_CHARS = 2000, 2_000_000
#: Words that are searched at a time, or twice the widest window.
STRETCH = 65_536
_NONE = 1 << 60
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words up to its last question mark or else before its last sentence, and the rest."""
    at = text.rfind("?") + 1
    if not at or not tokens(text[at:]):
        ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.strip())]
        at = ends[-1] if ends else 0
    question, answer = tokens(text[:at]), tokens(text[at:])
    return (question, answer) if question else (answer, [])


def _runs(words: list[str]) -> set[tuple[str, ...]]:
    n = min(RUN, len(words))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()


@dataclass
class _Block:
    items: list[int]
    thresholds: np.ndarray
    impacts: list[dict[int, float]]


@dataclass
class _Class:
    width: int
    blocks: list[_Block]
    lowest: list[float]             # what the terms with postings must bring, by block
    floors: list[float]             # the least of these from each block on
    peak: np.ndarray                # best impact of each term, 0 without postings; one more for unknown words
    lists: dict[int, tuple[list[int], list[float]]]  # postings: blocks in order, and each block's best impact

    def above(self, seen: set[int]) -> Iterator[tuple[int, float]]:
        """(item, score as a share of its own) of the items above threshold, by block-max WAND.

        Cursors stand in the postings of the terms, in order of their blocks. The pivot is the first one
        at which the peaks so far reach what the least demanding block ahead needs: no block before it can
        qualify. If the first cursor is
        there too, the block's own maxima decide whether its items are scored; else the cursors before
        the pivot skip to it.
        """
        cursors = [[self.lists[t][0][0], float(self.peak[t]), 0, *self.lists[t]] for t in seen if t in self.lists]
        while True:
            cursors.sort(key=lambda c: c[0])
            reach, need = 0.0, self.floors[cursors[0][0]] - 1e-9 if cursors else 0.0
            for at, cursor in enumerate(cursors):
                reach += cursor[1]
                if reach >= need:
                    pivot = cursor[0]
                    break
            else:
                return
            if cursors[0][0] == pivot:
                number = pivot
                best = sum(c[4][c[2]] for c in cursors if c[0] == pivot)
                if best >= self.lowest[number] - 1e-9:
                    block = self.blocks[number]
                    for item, threshold, own in zip(block.items, block.thresholds, block.impacts):
                        score = sum(own[t] for t in own.keys() & seen)
                        if score >= threshold - 1e-9:
                            yield item, float(score / threshold * SHARE)
                pivot += 1
            for cursor in cursors[:at + 1] if pivot == cursors[at][0] else cursors:
                if cursor[0] < pivot:
                    cursor[2] = bisect_left(cursor[3], pivot, cursor[2])
                    cursor[0] = cursor[3][cursor[2]] if cursor[2] < len(cursor[3]) else _NONE
            cursors = [c for c in cursors if c[0] != _NONE]


@dataclass
class Statistics:
    """What BM25 takes from the whole benchmark: items and words of items that have one, items by term."""

    items: int
    words: int
    present: dict[str, int]


class Index:
    """BM25 impacts of one set of items, by length class and block.

    ``whole`` are the statistics of the benchmark of which the items are a part, with their terms at
    least; without it the items are the benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        words = {item: tokens(text) for item, text in items}
        items = [(item, text) for item, text in items if words[item]]
        self.items = {item: question_and_answer(text) for item, text in items}
        self.terms: dict[str, int] = {}
        present = Counter(w for item, _ in items for w in set(words[item]))
        for w in present:
            self.terms[w] = len(self.terms)
        whole = whole or Statistics(len(items), sum(len(words[item]) for item, _ in items), present)
        present = {w: whole.present[w] for w in present}
        mean = whole.words / max(1, whole.items)
        idf = {w: float(np.log1p((whole.items - n + 0.5) / (n + 0.5))) for w, n in present.items()}
        impact = {item: {self.terms[w]: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words[item]) / mean))
                         for w, n in Counter(words[item]).items()} for item, _ in items}
        by_class: dict[int, list[int]] = defaultdict(list)
        for item, _ in items:
            by_class[max(3, (len(words[item]) - 1).bit_length())].append(item)
        self.classes = []
        for power, own in sorted(by_class.items()):
            # Items alike in threshold share a block, so its lowest threshold is telling.
            own.sort(key=lambda i: (sum(impact[i].values()), i))
            self.classes.append(self._class(1 << power, own, impact, present))

    def _class(self, width: int, own: list[int], impact: dict[int, dict[int, float]], present: dict[str, int]) -> _Class:
        names = list(self.terms)
        blocks, lowest, lists = [], [], defaultdict(dict)
        for at in range(0, len(own), BLOCK):
            items = own[at:at + BLOCK]
            thresholds = np.array([SHARE * sum(impact[i].values()) for i in items])
            needs = []
            for item, threshold in zip(items, thresholds):
                left = threshold
                for term, value in sorted(impact[item].items(), key=lambda tv: (-present[names[tv[0]]], tv[0])):
                    if threshold - left + value > OPEN * threshold:
                        lists[term][len(blocks)] = max(value, lists[term].get(len(blocks), 0.0))
                    else:
                        left -= value
                needs.append(left)
            blocks.append(_Block(items, thresholds, [impact[i] for i in items]))
            lowest.append(min(needs))
        peak = np.zeros(len(names) + 1)
        for term, own_list in lists.items():
            peak[term] = max(own_list.values())
        ordered = {term: (sorted(own_list), [own_list[b] for b in sorted(own_list)]) for term, own_list in lists.items()}
        return _Class(width, blocks, lowest, np.minimum.accumulate(lowest[::-1])[::-1].tolist(), peak, ordered)

    def retrieve(self, texts: list[list[str]]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score as a share of the item's own, first word, end) of windows above threshold.

        Texts are read in stretches of a bounded number of words, which overlap so that every window lies
        whole in one.
        """
        widest = max((cls.width for cls in self.classes), default=1)
        step = max(STRETCH, 2 * widest) // widest * widest
        own: list[tuple[int, int, np.ndarray, bool]] = []
        held = 0
        for which, words in enumerate(texts):
            for at in range(0, max(1, len(words)), step):
                if at and at + widest >= len(words):
                    break  # the stretch before holds all of it
                part = words[at:at + step + widest]
                own.append((which, at, np.fromiter(map(self.terms.get, part, repeat(len(self.terms))), np.int64, len(part)), at + step + widest >= len(words)))
                held += len(part)
                if held >= step:
                    yield from self._search(own, step)
                    own, held = [], 0
        yield from self._search(own, step)

    def _search(self, stretches: list[tuple[int, int, np.ndarray, bool]], step: int) -> Iterator[tuple[int, int, float, int, int]]:
        if not stretches:
            return
        sizes = np.array([len(ids) for _, _, ids, _ in stretches], np.int64)
        ids = np.concatenate([ids for _, _, ids, _ in stretches])
        start = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(stretches)), sizes)
        place = np.arange(len(ids)) - start[owner]
        for cls in self.classes:
            here = np.flatnonzero(cls.peak[ids] > 0)
            if not len(here):
                continue
            # Halves of windows: a window is one and the next one. Each term counts once in a half.
            ending = np.array([last for _, _, _, last in stretches])
            windows = np.where(ending, -(-np.maximum(1, sizes - cls.width) // cls.width), step // cls.width)
            base = np.cumsum(windows + 1) - windows - 1
            half = np.minimum(place[here] // cls.width, windows[owner[here]]) + base[owner[here]]
            half, term = np.divmod(np.unique(half * len(cls.peak) + ids[here]), len(cls.peak))
            most = np.bincount(half, cls.peak[term], int((windows + 1).sum()) + 1)
            for w in np.flatnonzero(most[:-1] + most[1:] >= cls.floors[0] - 1e-9):
                part = int(np.searchsorted(base, w, "right")) - 1
                number = int(w - base[part])
                if number >= windows[part]:
                    continue
                which, offset, own, _ = stretches[part]
                first, end = number * cls.width, min((number + 2) * cls.width, len(own))
                seen = set(own[first:end].tolist())
                for item, share in cls.above(seen):
                    yield which, item, share, offset + first, offset + end

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the items it holds: {item: (score share, question overlap, answer overlap)}."""
        words = [tokens(t) for t in texts]
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        for which, item, share, first, end in self.retrieve(words):
            question, answer = self.items[item]
            window = words[which][first:end]
            found = (share, _overlap(question, window), _overlap(answer, window) if answer else 1.0)
            if _overlap(question + answer, window) >= OVERLAP and found > out[which].get(item, (0.0, 0.0, 0.0)):
                out[which][item] = found
        return out


def _overlap(part: list[str], window: list[str]) -> float:
    """Share of the part's runs of words that the window holds; a shorter part is one run."""
    own = _runs(part)
    if not own:
        return 0.0
    n = min(RUN, len(part))
    held = {tuple(window[k:k + n]) for k in range(len(window) - n + 1)}
    return len(own & held) / len(own)


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts, texts in slices(batches):
        words = [tokens(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int64()), pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
            ["part", "size", "terms"])


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """One index after the other, each of a bounded number of items and characters.

    All take their statistics from the whole benchmark, so an item scores the same in any part.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where(
        F.col("item").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["item"])
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-2 * total["n"] // INDEX_ITEMS) if total["n"] > INDEX_ITEMS else 1,
                -(-2 * (total["chars"] or 0) // INDEX_CHARS) if (total["chars"] or 0) > INDEX_CHARS else 1)
    if parts > 1:
        rows = saved(rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))))
        words = saved(rows.select("part", "text").mapInArrow(_terms, "part long, size long, terms array<string>").where("size > 0"))
        sums = words.agg(F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        held = words.select("part", F.explode("terms").alias("term")).groupBy("part", "term").agg(F.count("*").alias("n"))
        present = saved(held.join(held.groupBy("term").agg(F.sum("n").alias("items")), "term").select("part", "term", "items"))
    for part in range(parts if total["n"] else 0):
        own, whole = rows, None
        if parts > 1:
            own = rows.where(F.col("part") == part)
            whole = Statistics(sums["items"], sums["words"], {r["term"]: r["items"] for r in present.where(F.col("part") == part).collect()})
        yield Index([(r["item"], r["text"]) for r in own.select("item", "text").orderBy("item").collect()], whole)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Null and empty texts, and items without a word, match nothing. Texts are read whole. Repeated rows
    give repeated findings; a null id stays null. Other columns are not carried. Without documents or
    items there are no rows.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for ids, texts in slices(batches):
                rows = [(doc, item, *found) for doc, own in zip(ids, shared.value.leaks(texts)) for item, found in sorted(own.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(search, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                clean = [not own for at in range(0, len(texts), SLICE) for own in shared.value.leaks(texts.slice(at, SLICE).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
