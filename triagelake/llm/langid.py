"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters give hashed runs of two, three and four characters (word edges included); the mean
of their embeddings goes through a linear layer. Embeddings and layer are trained by stochastic
gradient descent in numpy on excerpts of a bounded sample of labelled documents. For prediction the
two are one table of scores per hash, so whole texts cost one lookup per run. Probabilities are
calibrated by a temperature, and a text whose best probability is below a limit learned from held-back
excerpts is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triagelake.llm.common import held_out, slices

UNKNOWN = "und"
BUCKET_BITS, WIDTH = 16, 16
#: Bounds of the training sample: documents in all (one of each language at least) and of each language,
#: excerpts per document and their letters.
DOCS, DOCS_PER_LANG, EXCERPTS, EXCERPT_CHARS = 8000, 1000, 2, 200
#: Of the held-back excerpts of languages this share may be rejected, of the shuffled ones this share may pass.
LOSS, PASS = 0.001, 0.01
#: The label of shuffled excerpts.
NOISE = "\0"
#: Characters of one step over a long text.
STEP = 1 << 20
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)], bool)


def codes(text: str) -> np.ndarray:
    """Lower-cased code points, every run of other than letters as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where(points < 0x3000, _LETTER[np.minimum(points, 0x2FFF)], True)
    letters &= ~((points >= 0xD800) & (points < 0xF900)) & ~((points >= 0x1F000) & (points < 0x20000))
    points = np.where(letters, points, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    return points[keep]


def hashes(points: np.ndarray) -> np.ndarray:
    """Bucket of every run of two, three and four characters."""
    out, h = [], points.astype(np.uint32)
    for n in (2, 3, 4):
        if len(points) < n:
            break
        h = (h[:len(points) - n + 1] ^ np.uint32(n)) * np.uint32(0x9E3779B1) + points[n - 1:]
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # scores of each bucket, one column per label
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 1.0  # the last column is noise; from this probability of it on a text is rejected

    def mean_scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels) + 1), 0
        padded = " " + text + " "
        for at in range(0, len(padded), STEP):
            runs = hashes(codes(padded[at:at + STEP + 3]))
            total += self.table[runs].sum(axis=0, dtype=np.float64)
            n += len(runs)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected); texts without a letter are 'und' and rejected."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.mean_scores(text)[None] / self.temperature)[0]
        best = int(p[:-1].argmax())
        return self.labels[best], float(p[best]), bool(p[-1] > self.limit)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shuffled(text: str, random: np.random.Generator) -> str:
    """An excerpt that is no language: its characters in another order, some of them at random, one of them, or foreign letters."""
    kind, own = random.integers(0, 5), list(text)
    if kind < 2:
        random.shuffle(own)
    elif kind == 2:
        own = random.choice(own, len(own)).tolist()
    elif kind == 3:
        own = [random.choice(own)] * len(own)
    else:
        own = [" " if c == " " else chr(random.integers(0x400, 0xD7A0)) for c in own]
    return "".join(own)


def _excerpts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed runs of a few excerpts of each document, of differing lengths."""
    for ids, texts, langs in slices(batches):
        rows = []
        for doc, text, lang in zip(ids, texts, langs):
            if not has_letter(text):
                continue
            random = np.random.default_rng(abs(doc or 0))
            for number in range(EXCERPTS):
                length = int(EXCERPT_CHARS * random.uniform(0.04, 1) ** 2) + 8
                at = int(random.integers(0, max(1, len(text) - length)))
                for label, own in ((lang, text[at:at + length]), (NOISE, _shuffled(text[at:at + length], random)))[:1 + (number == 0)]:
                    runs = hashes(codes(" " + own + " "))
                    if len(runs):
                        rows.append((doc, label, runs.astype(np.int32).tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.int32())))], ["doc", "lang", "runs"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 12,
        rate: float = 0.8) -> Model:
    """Train on at most DOCS_PER_LANG documents (about, by a hash of the id) of each labelled language."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc").isNotNull() & ~held_out(F.col("doc")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1))
    # About so many of each language, by a hash of the id; one number for each language, no join.
    each = max(1, min(DOCS_PER_LANG, DOCS // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, (each << 20) // n))])
    chosen = F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 20)) < F.element_at(share, F.col("lang"))
    sample = rows.where(chosen).select("doc", "text", "lang").mapInArrow(
        _excerpts, "doc long, lang string, runs array<int>").orderBy("doc").toArrow()
    told = np.array(sample.column("lang").to_pylist(), object)
    labels = sorted(set(told) - {NOISE})
    if not labels:
        return Model([], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1))
    number = {label: k for k, label in enumerate([*labels, NOISE])}
    runs = [np.array(r) for r in sample.column("runs").to_pylist()]
    doc = sample.column("doc").to_numpy()
    back = np.unique(doc, return_inverse=True)[1] % 5 == 4  # for calibration
    return _train(labels, runs, np.array([number[v] for v in told]), back, epochs, rate)


def _train(labels: list[str], runs: list[np.ndarray], y: np.ndarray, back: np.ndarray, epochs: int, rate: float) -> Model:
    random = np.random.default_rng(7)
    embed = random.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH))
    layer, bias = random.normal(0, 0.1, (WIDTH, len(labels) + 1)), np.zeros(len(labels) + 1)
    use, held = np.flatnonzero(~back), np.flatnonzero(back)
    weight = len(y) / ((len(labels) + 1) * np.maximum(1, np.bincount(y, minlength=len(labels) + 1)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        random.shuffle(use)
        for at in range(0, len(use), 32):
            batch = use[at:at + 32]
            sizes = np.array([len(runs[i]) for i in batch])
            flat = np.concatenate([runs[i] for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(embed[flat], starts) / sizes[:, None]
            error = softmax(mean @ layer + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            error *= weight[y[batch]][:, None]
            down = error @ layer.T / sizes[:, None]
            layer -= step * mean.T @ error / len(batch) * 4
            bias -= step * error.mean(axis=0) * 0.2
            unique, where = np.unique(flat, return_inverse=True)
            spread = np.repeat(down, sizes, axis=0)
            change = np.stack([np.bincount(where, spread[:, k], len(unique)) for k in range(WIDTH)], axis=1)
            embed[unique] -= step * change * 4
    model = Model(labels, (embed @ layer).astype(np.float32), bias)
    if len(held):
        z = np.stack([model.table[runs[i]].mean(axis=0) for i in held]) + bias
        picked = np.arange(len(held)), y[held]
        losses = {t: -np.log(softmax(z / t)[picked] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)}
        model.temperature = min(losses, key=losses.get)
        model.limit = _limit(model, [runs[i] for i in held if y[i] < len(labels)], [runs[i] for i in held if y[i] == len(labels)])
    return model


def _limit(model: Model, true: list[np.ndarray], noise: list[np.ndarray]) -> float:
    """The probability of noise that parts held-back excerpts from shuffled ones; excerpts of two languages count as true."""
    def chances(excerpts: list[np.ndarray]) -> np.ndarray:
        z = np.stack([model.table[r].mean(axis=0) for r in excerpts]) + model.bias
        return softmax(z / model.temperature)[:, -1]

    if not true:
        return 1.0
    mixed = [np.concatenate([a, b]) for a, b in zip(true, true[len(true) // 2:] + true[:len(true) // 2])]
    highest = float(np.quantile(chances(true + mixed), 1 - LOSS))
    lowest = float(np.quantile(chances(noise), PASS)) if noise else 1.0
    if lowest <= highest:
        return highest
    # Half way between the two in log-odds.
    odds = [np.log(max(x, 1e-12) / max(1 - x, 1e-12)) for x in (highest, lowest)]
    return float(1 / (1 + np.exp(-sum(odds) / 2)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    Null texts and texts without a letter are 'und', score 0, rejected. Texts of any length are read
    whole. Repeated rows are told each on its own; a null id stays null; other columns are not carried;
    an empty table gives no rows. A model without labels calls everything 'und'.
    """
    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            lang, score, out = zip(*map(model.predict, texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lang), pa.array(score), pa.array(out)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        told, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language the model can tell. Null texts go."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            good = [not model.predict(t)[2] for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
