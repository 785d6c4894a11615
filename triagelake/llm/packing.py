"""Best-fit packing by exact complements.

Tokenising is one narrow pass. The plan is made from the histogram of piece lengths, at most 2048
numbers whatever the input: an index of the sums of one, two and three available lengths gives the
combinations that fill a gap exactly, which are used as often as the counts allow; what is left is
packed best fit.
Pieces then find their place by their rank among the pieces of their length, from counts per partition.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from triagelake.llm.common import partition_id, saved, slices
from triagelake.llm.tokens import encoder

SIZE = 2048


def text_ids(text: str | None, tokenizer_path: str) -> bytes:
    """The ids of a whole text, little-endian unsigned 32-bit, with the closing id 0."""
    return encoder(tokenizer_path)(text or "") + b"\0\0\0\0"


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """Every document cut into pieces of ``size`` tokens, the last one shorter.

    ``part`` and ``seat`` say where a piece stands among those of its length in its partition; they
    are facts of the written table, so the result must be saved before it is used twice.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seat long" + (", ids binary" if keep_ids else "")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seats = partition_id(), Counter()
        for ids, texts in slices(batches):
            rows = []
            for doc, text in zip(ids, texts):
                whole = text_ids(text, tokenizer_path)
                for number, at in enumerate(range(0, len(whole), 4 * size)):
                    own = whole[at:at + 4 * size]
                    length = len(own) >> 2
                    rows.append((doc, number, at >> 2, length, zlib.crc32(own), part, seats[length]) + ((own,) if keep_ids else ()))
                    seats[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seat", "ids"][:7 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, schema)


class SumIndex:
    """Sums of one, two and three available lengths, each sum with the combinations that give it.

    ``left`` counts the pieces of each length. A pair is listed under its sum by its shorter length, a
    triple by its longest one, the longest lengths first. Counts only fall, so a combination at the head
    of a list whose length has run out is dropped for good.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = [0] * (size + 1)
        for length, n in counts.items():
            self.left[length] += n
        have = np.array(self.left) > 0
        self.pairs: list[list[int]] = [[], []]
        for total in range(2, size):
            low = np.arange(1, total // 2 + 1)
            self.pairs.append(low[have[low] & have[total - low]].tolist())
        paired = np.array([bool(p) for p in self.pairs])
        self.triples: list[list[int]] = [[], [], []]
        for total in range(3, size):
            longest = np.arange(total - 2, (total + 2) // 3 - 1, -1)
            self.triples.append(longest[have[longest] & paired[total - longest]].tolist())
        self.pair_at, self.triple_at = [0] * max(size, 2), [0] * max(size, 3)

    def free(self, length: int, held: list[int]) -> int:
        return self.left[length] - held.count(length)

    def pair(self, total: int, held: list[int]) -> list[int] | None:
        lows = self.pairs[total]
        for k in range(self.pair_at[total], len(lows)):
            low, high = lows[k], total - lows[k]
            if self.left[low] and self.left[high]:
                if self.free(low, held) > 0 and self.free(high, held) > (low == high):
                    return [high, low]
            elif k == self.pair_at[total]:
                self.pair_at[total] += 1
        return None

    def triple(self, total: int, held: list[int]) -> list[int] | None:
        longest = self.triples[total]
        for k in range(self.triple_at[total], len(longest)):
            length = longest[k]
            if not self.left[length]:
                self.triple_at[total] += k == self.triple_at[total]
            elif self.pair_at[total - length] < len(self.pairs[total - length]) and self.free(length, held) > 0:
                two = self.pair(total - length, [*held, length])
                if two:
                    return [length, *two]
        return None

    def complement(self, gap: int, held: list[int]) -> list[int] | None:
        """Available lengths that fill ``gap`` exactly beside those ``held``, as few as can be."""
        if not gap:
            return []
        if self.free(gap, held) > 0:
            return [gap]
        return self.pair(gap, held) or self.triple(gap, held)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces in each}) until every piece of the histogram is used."""
    index = SumIndex(counts, size)
    left = index.left
    plan: list[tuple[int, dict[int, int]]] = []

    def use(parts: list[int]) -> None:
        need = Counter(parts)
        times = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= times * n
        plan.append((times, dict(need)))

    for first in range(size, 0, -1):
        while left[first] > 0 and (rest := index.complement(size - first, [first])) is not None:
            use([first, *rest])
    rest_of = np.array(left)
    while rest_of.any():
        first = int(np.flatnonzero(rest_of)[-1])
        parts, free, gap = [first], rest_of.copy(), size - first
        free[first] -= 1
        while gap and len(fit := np.flatnonzero(free[:gap + 1])):
            best = int(fit[-1])
            n = int(min(free[best], gap // best))
            parts += [best] * n
            free[best] -= n
            gap -= n * best
        use(parts)
        rest_of = np.array(left)
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The ranks of each length that a kind of bin takes, as sorted arrays."""
    used, base, rows = Counter(), 0, []
    for times, need in plan:
        offset = 0
        for length, n in need.items():
            rows.append(((length << 44) + used[length], used[length], n, base, offset))
            used[length] += times * n
            offset += length * n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "start", "each", "base", "offset"), table.T.copy()))


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece holding id 0 alone. Repeated rows are packed each on its own, a
    null id stays null. Other columns are not carried. An empty table gives no rows.
    """
    cut = saved(pieces(docs, tokenizer_path, size, id_col, text_col, keep_ids))
    by_part = cut.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = _slots(plan_bins(counts, size))
    before = by_part.select("part", "length", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("seat"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.searchsorted(slots["key"], (length << 44) + rank, "right") - 1
            inside, each = rank - slots["start"][slot], slots["each"][slot]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in columns]
                + [pa.array(slots["base"][slot] + inside // each), pa.array(slots["offset"][slot] + inside % each * length)],
                [*columns, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    return ranked.select(*columns, "rank").mapInArrow(
        place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence in order; ``packed`` must hold ``ids``. A group is one sequence."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(rows, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))
