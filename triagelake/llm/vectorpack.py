"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. An example is a vector of these
as shares of the limits. One sequence is open at a time; it takes the example that fits and whose
vector has the largest dot product with what is left in the sequence, each dimension weighted by how
much of it the waiting examples ask for. An example that fills the tokens exactly goes first. When
nothing fits, a waiting example is cut to close the gap; when nothing can, the sequence is cut down to
a power of two, which needs no padding, and the rest waits on.

Each task packs the examples of its own partition in pools of bounded size, so nothing shuffles and a
lost task is packed again alike. Padding does not depend on how rows are spread.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from triagelake.llm.common import partition_id, slices
from triagelake.llm.tokens import encoder

#: Examples (each shorter than a sequence) that wait together in one task.
POOL = 8192
#: The id that closes an example.
END_ID = 1


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. All must be at least 1."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Example:
    """A stretch of a document's ids that still has to be placed; ids before ``silent`` bear no loss."""

    doc: int | None
    start: int
    ids: bytes
    silent: int
    total: int

    @property
    def length(self) -> int:
        return len(self.ids) >> 2

    def loss(self) -> int:
        return self.length - self.quiet()

    def quiet(self) -> int:
        """How many of its first ids bear no loss."""
        return min(max(self.silent - self.start, 0), self.length)

    def cut(self, n: int) -> tuple["Example", "Example"]:
        return (Example(self.doc, self.start, self.ids[:4 * n], self.silent, self.total),
                Example(self.doc, self.start + n, self.ids[4 * n:], self.silent, self.total))


class Pool:
    """Waiting examples by (tokens, loss-bearing tokens), and the sequences made of them."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: dict[tuple[int, int], deque[Example]] = defaultdict(deque)
        self.kinds = np.zeros((0, 3), np.int64)
        self.count = np.zeros(0, np.int64)
        self.row: dict[tuple[int, int], int] = {}
        self.size = 0

    def add(self, example: Example) -> None:
        kind = (example.length, example.loss())
        if kind not in self.row:
            if len(self.row) == len(self.kinds):
                room = max(256, 2 * len(self.kinds))
                self.kinds = np.concatenate([self.kinds, np.zeros((room - len(self.kinds), 3), np.int64)])
                self.count = np.concatenate([self.count, np.zeros(room - len(self.count), np.int64)])
            self.row[kind] = at = len(self.row)
            self.kinds[at] = kind[0], 1, kind[1]
        self.waiting[kind].append(example)
        self.count[self.row[kind]] += 1
        self.size += 1

    def take(self, at: int) -> Example:
        self.count[at] -= 1
        self.size -= 1
        return self.waiting[int(self.kinds[at, 0]), int(self.kinds[at, 2])].popleft()

    def tidy(self) -> None:
        """Forget kinds that no example has."""
        alive = [(kind, self.waiting[kind]) for kind, at in self.row.items() if self.count[at]]
        self.waiting = defaultdict(deque, alive)
        self.row = {kind: at for at, (kind, _) in enumerate(alive)}
        self.kinds = np.array([(length, 1, loss) for (length, loss), _ in alive], np.int64).reshape(-1, 3)
        self.count = np.array([len(own) for _, own in alive], np.int64)

    def sequence(self) -> list[Example]:
        """The next sequence; at least one example must wait."""
        room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)
        share = self.kinds / self.scale
        weight = self.count @ share
        out: list[Example] = []
        while room[0] and room[1]:
            fits = (self.count > 0) & (self.kinds <= room).all(axis=1)
            exact = np.flatnonzero(fits & (self.kinds[:, 0] == room[0]))
            if len(exact):
                at = int(exact[0])
            elif fits.any():
                at = int(np.argmax(np.where(fits, share @ (weight * room / self.scale), -1.0)))
            else:
                break
            out.append(self.take(at))
            room -= self.kinds[at]
        if room[0] and room[1]:
            closing = self._closing(room)
            if closing:
                out.append(closing)
                room -= closing.length, 1, closing.loss()
        if room[0]:
            self._trim(out, self.limits.tokens - int(room[0]))
        return out

    def _closing(self, room: np.ndarray) -> Example | None:
        """The beginning of a waiting example that fills the gap, the rest waits on."""
        gap, loss = int(room[0]), int(room[2])
        for at in np.flatnonzero((self.count > 0) & (self.kinds[:, 0] > gap))[::-1]:
            example = self.waiting[int(self.kinds[at, 0]), int(self.kinds[at, 2])][0]
            if gap - min(example.quiet(), gap) <= loss:
                head, rest = self.take(int(at)).cut(gap)
                self.add(rest)
                return head
        return None

    def _trim(self, out: list[Example], length: int) -> None:
        """Cut the end of a short sequence so that a power of two stays."""
        surplus = length - (1 << length.bit_length() - 1)
        while surplus:
            last = out.pop()
            if last.length > surplus:
                head, rest = last.cut(last.length - surplus)
                out.append(head)
                self.add(rest)
                surplus = 0
            else:
                self.add(last)
                surplus -= last.length


def _stretches(example: Example, limits: Limits) -> Iterator[Example]:
    """An example cut so that each stretch can lie in a sequence of its own."""
    while example.length > limits.tokens or example.loss() > limits.loss:
        head, example = example.cut(min(example.length, limits.tokens, example.quiet() + limits.loss))
        yield head
    yield example


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
         prompt: Column | None = None, end_id: int = END_ID, pool: int = POOL, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, segment, sequence_id, offset (and ids).

    An example is the ids of its prompt, of its text, and ``end_id``; those of the prompt bear no loss.
    Sequences are full or as long as a power of two, so none needs padding. A null or empty text is
    ``end_id`` alone, a null prompt is empty. Texts are read whole; long ones are cut. Repeated rows are
    packed each on its own, a null id stays null. Other columns are not carried, whatever their names.
    An empty table gives no rows.
    """
    types = [pa.int64()] * 9 + [pa.binary()] * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "segment", "sequence_id", "offset"] + ["ids"] * keep_ids

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        number, waiting, rows = partition_id() << 40, Pool(limits), []

        def sequences(fewest: int) -> None:
            nonlocal number
            while waiting.size > fewest:
                at = 0
                for segment, e in enumerate(waiting.sequence()):
                    rows.append((e.doc, e.start, e.length, zlib.crc32(e.ids), e.total, e.loss(), segment, number, at, e.ids)[:len(types)])
                    at += e.length
                number += 1
            waiting.tidy()

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)
            rows.clear()
            return batch

        for ids, prompts, texts in slices(batches):
            for doc, before, text in zip(ids, prompts, texts):
                quiet = encode(before) if before else b""
                whole = quiet + (encode(text) if text else b"") + last
                for part in _stretches(Example(doc, 0, whole, len(quiet) >> 2, len(whole) >> 2), limits):
                    waiting.add(part)
                    if waiting.size >= pool:
                        sequences(pool // 2)
                        yield written()
        sequences(0)
        yield written()

    before = F.lit(None).cast("string") if prompt is None else prompt.cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), before.alias("before"), F.col(text_col).alias("text")).mapInArrow(
        place, ", ".join(f"{n} long" for n in names[:9]) + ", ids binary" * keep_ids)
