"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens are words and their beginnings, so inflected forms count together. They get the log-odds of
being in toxic against other labelled documents under a Dirichlet prior taken from the whole sample;
only those that differ beyond chance keep their weight, a word has the largest of its tokens, and
every word pays a small toll. One linear scan per text then finds every maximal scoring segment. Segment scores follow
an extreme-value law in ordinary text, so each gets an expected number of equally good segments in
a text of that length; the significant ones add up to one statistic, which a logistic curve turns
into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triagelake.llm.common import held_out, saved, share_of, slices

#: Bounds of the training sample: rows of each label. The model has all of its words that differ beyond chance.
TOXIC_ROWS, OTHER_ROWS = 3000, 6000
#: Weight of the prior in documents; least standard errors from zero; what each word pays.
PRIOR_DOCS, MIN_Z, TOLL = 20.0, 4.0, 0.3
#: Lengths of the beginnings that are tokens.
STEMS = (4, 5, 6)
#: Words whose weight one Python worker remembers.
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0      # lambda of the extreme-value law
    room: float = 0.1      # K of the extreme-value law
    curve: tuple[float, float] = (-4.0, 0.0)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def tokens(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class _Weights(dict):
    """Weight of each word met, None for most: the largest of its tokens'."""

    def __init__(self, model: Model):
        self.of = model.weights.get

    def __missing__(self, word: str) -> float | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = best = max(filter(None, map(self.of, tokens(word))), default=None)
        return best


def segments(scores: list[tuple[int, float]], toll: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of tokens that pay ``toll`` each.

    ``scores`` has the place and weight of the tokens that gain. A candidate keeps the running total at
    its two ends and a link to the nearest earlier candidate that starts lower, so the scan is linear.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []
    total, at_place = 0.0, 0
    for place, weight in scores:
        low = total - toll * (place - at_place)
        start, high = place, low + weight - toll
        total, at_place = high, place + 1
        if high <= low:
            continue
        while True:
            lower = len(stack) - 1
            while lower >= 0 and stack[lower][2] >= low:
                lower = stack[lower][4]
            if lower < 0:
                # Nothing starts lower: what stands so far can no longer grow.
                done += [(a, b, r - l) for a, b, l, r, _ in stack]
                stack.clear()
                break
            if stack[lower][3] >= high:
                break
            start, low = stack[lower][0], stack[lower][2]
            del stack[lower:]
        stack.append((start, place, low, high, lower))
    return done + [(a, b, r - l) for a, b, l, r, _ in stack]


def evidence(text: str | None, model: Model, known: _Weights) -> tuple[float, list[tuple[int, int, float]]]:
    """(summed significance, significant segments as first word, last word, expected number)."""
    own = words(text)
    found = [(i, w) for i, w in enumerate(map(known.__getitem__, own)) if w is not None]
    total, out = 0.0, []
    for first, last, score in segments(found, TOLL):
        expected = math.log(model.room * max(len(own), 1)) - model.rate * score
        if expected < math.log(0.5):
            total += -expected
            out.append((first, last, math.exp(expected)))
    return total, out


def probability(x: float, model: Model) -> float:
    a, b = model.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(x)))))


def _token_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many other and toxic documents hold each token, so far as this task has seen."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        both = [(w, n if not k else 0, n if k else 0) for k in (0, 1) for w, n in counts[k].items()]
        counts[0].clear(), counts[1].clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*both), (pa.string(), pa.int64(), pa.int64()))],
                                          ["word", "other", "toxic"])

    for texts, toxic in slices(batches):
        for text, label in zip(texts, toxic):
            counts[int(label)].update({t for w in set(words(text)) for t in tokens(w)})
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield rows()
    if counts[0] or counts[1]:
        yield rows()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(toxic_col).cast("int").alias("toxic")).where(
        F.col("doc").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc")))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    known = known.where(((F.col("toxic") == 1) & share_of(F.col("doc"), TOXIC_ROWS, n[1]))
                        | ((F.col("toxic") == 0) & share_of(F.col("doc"), OTHER_ROWS, n[0]))).dropDuplicates(["doc"])
    # Bounded by TOXIC_ROWS + OTHER_ROWS ids. Copies of a text teach once.
    sample = saved(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc")
                   .withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "toxic"]).select("text", "toxic"))
    size = {r["toxic"]: float(r["count"]) for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0.0), size.get(1, 0.0)
    if not n0 or not n1:
        return Model()
    counts = sample.mapInArrow(_token_counts, "word string, other long, toxic long").groupBy("word").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    prior = PRIOR_DOCS * (F.col("other") + F.col("toxic")) / (n0 + n1)
    one, zero = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(one / (n1 + PRIOR_DOCS - one)) - F.log(zero / (n0 + PRIOR_DOCS - zero))
    strong = (counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / one + 1 / zero)).where(F.col("z") > MIN_Z)
              .orderBy(F.desc("z"), "word").collect())
    model = Model({r["word"]: float(r["odds"]) for r in strong if r["odds"] > TOLL})
    # Chance of each weight per word of ordinary text, a document taken as some hundred words.
    model.rate = _rate([(model.weights[r["word"]] - TOLL, r["other"]) for r in strong if r["word"] in model.weights], 100 * n0)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(model)
        for texts, toxic in slices(batches):
            tops, sizes = [], []
            for text in texts:
                own = words(text)
                hits = [(i, w) for i, w in enumerate(map(known.__getitem__, own)) if w is not None]
                tops.append(max((s for _, _, s in segments(hits, TOLL)), default=0.0))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(tops), pa.array(sizes, pa.int64()), pa.array(toxic, pa.int32())], ["top", "n", "toxic"])

    plain = sample.where("toxic = 0").mapInArrow(measured, "top double, n long, toxic int").toArrow()
    top, size = plain.column("top").to_numpy(), plain.column("n").to_numpy()
    some = top > 0
    # K from the ordinary texts: the mean of lambda * S - ln(n) is ln(K) + Euler's constant in that law.
    if some.any():
        expected = float(np.sum(np.exp(-model.rate * top[some]) * np.maximum(size[some], 1)))
        model.room = float(np.clip(some.sum() / max(expected, 1e-9), 1e-4, 1.0))

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(model)
        for texts, toxic in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([evidence(t, model, known)[0] for t in texts], pa.float64()), pa.array(toxic, pa.int32())], ["x", "toxic"])

    both = sample.mapInArrow(seen, "x double, toxic int").toArrow()
    rows = np.log1p(both.column("x").to_numpy()), both.column("toxic").to_numpy().astype(float)
    model.curve = _logistic(*rows, weight=np.where(rows[1] == 1, n[1] / max(1, (rows[1] == 1).sum()), n[0] / max(1, (rows[1] == 0).sum())))
    return model


def _rate(gains: list[tuple[float, int]], tokens: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over ordinary tokens."""
    mass = [(g, max(n, 0.5) / tokens) for g, n in gains]
    rest = max(1e-6, 1 - sum(p for _, p in mass))
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        value = rest * math.exp(-mid * TOLL) + sum(p * math.exp(min(mid * g, 500)) for g, p in mass)
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Two coefficients by Newton steps with a little ridge."""
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 0.1 * beta
        bend = design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        change = np.linalg.solve(bend, slope)
        beta += np.clip(change, -4, 4)
        if np.abs(change).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, passages (first and last word, expected number by chance) of every row.

    A text without a significant passage, empty or null ones too, gets the curve's value at zero.
    Repeated rows are scored each on its own, a null id stays null, texts of any length are read whole,
    other columns are not carried, an empty table gives no rows.
    """
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("expected", pa.float64())]))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(model)
        for ids, texts in slices(batches):
            results = [evidence(t, model, known) for t in texts]
            p = [probability(x, model) for x, _ in results]
            spans = [[{"first": a, "last": b, "expected": e} for a, b, e in found] for _, found in results]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32()), pa.array(spans, passage)],
                ["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        scored, "doc_id long, score double, predicted int, passages array<struct<first:int,last:int,expected:double>>")
