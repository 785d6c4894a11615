"""Near-duplicate links and clusters over trigram Jaccard, exact and without pair lists.

Identical texts are folded into one representative first. Representatives meet in buckets
keyed by their rarest trigrams (a prefix filter, so no qualifying pair is missed). In each
bucket the smallest id is the hub and every member is compared with it: one comparison per
member. Members close enough to the hub need no other partner among themselves in that
bucket, because they are already connected through it; a bucket that stays crowded gets
further hubs. Only pairs the hubs do not explain are compared, in cells of bounded size, by
a parity sketch that never rejects a qualifying pair; the few survivors are verified.

Texts of one vocabulary share even their rarest trigrams, so buckets would compare a pair many
times over. Where comparing all texts of like size costs less than that, it is done instead:
``blocked_links`` meets blocks of texts in cells, of which each is array work of one task.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from triagelake import config as C
from triagelake.functions.text import jaccard, normalise_text
from triagelake.session import cut_lineage, spread

_WORDS = 8                      # 64-bit words of the parity sketch
_SKETCH = [f"s{i}" for i in range(_WORDS)]
_MAX_HUB_ROUNDS = 3
# A pair costs a cell some 30 ns and a bucket 50 times that; a trigram costs the buckets as much as 500 pairs of a cell.
_BUCKET_PAIR, _BUCKET_GRAM = 50, 500
# Pairs of a cell that are worth a call, and rows and trigrams that a block may hold.
_CELL_PAIRS, _BLOCK_ROWS, _BLOCK_GRAMS = 1 << 22, 8192, 1 << 22
_SKETCH_BITS = 2048             # of the parity sketch inside a cell
_PLANE = 4096                   # trigrams of one bit plane
_CHECKED_PAIRS = 1 << 20        # pairs of a cell verified together


def _representatives(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, words) of distinct comparable texts, and (id, rep) of every row."""
    # Normalised once, in the tasks the texts were spread over: a filter on it would sink below that exchange.
    rows = cut_lineage(texts.select("id", normalise_text(F.col("text")).alias("words")).withColumn("_key", F.sha2("words", 256)))
    rows = rows.filter(F.length("words") >= 3)
    reps = rows.groupBy("_key").agg(F.min("id").alias("rep"), F.any_value("words").alias("words"))
    members = rows.select("id", "_key").join(reps.select("_key", "rep"), "_key").select("id", "rep")
    return reps.select(F.col("rep").alias("id"), "words"), members


def _gram_sets(reps: DataFrame) -> DataFrame:
    """(id, grams, n): the distinct trigrams of each text; three code points of 21 bits are one number."""
    kind = reps.schema["id"].dataType.simpleString()

    def sets(batches):
        for batch in batches:
            for part in (batch.slice(start, 512) for start in range(0, batch.num_rows, 512)):
                found = []
                for words in part.column("words").to_pylist():
                    points = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                    found.append(np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
                n = np.array([len(x) for x in found], dtype=np.int32)
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), grams, pa.array(n)], ["id", "grams", "n"])

    return reps.mapInArrow(sets, f"id {kind}, grams array<bigint>, n int")


def _sketches(reps: DataFrame) -> DataFrame:
    """(id, n, parity bits) of each set: two sets differ in at least as many items as in bits."""
    tokens = reps.select("id", "n", F.explode("grams").alias("gram"))
    h = F.pmod(F.xxhash64("gram"), F.lit(64 * _WORDS))
    word, bit = F.floor(h / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    zero = F.lit(0).cast("long")
    return tokens.select("id", "n", word.alias("_w"), bit.alias("_b")).groupBy("id", "n").agg(
        *[F.bit_xor(F.when(F.col("_w") == i, F.col("_b")).otherwise(zero)).alias(c) for i, c in enumerate(_SKETCH)])


def _bits_apart(left, right) -> Column:
    """``left`` and ``right`` map a sketch column name to its value."""
    return reduce(lambda a, b: a + b, [F.bit_count(left(c).bitwiseXOR(right(c))) for c in _SKETCH])


def _may_qualify(bits: Column, sizes: Column, threshold: float) -> Column:
    """False only when the sketch proves the similarity is below the threshold."""
    return bits * F.lit(1 + threshold) <= sizes * F.lit(1 - threshold) + 1e-9


def _band(threshold: float) -> Column:
    """Texts whose sizes do not lie in the same or in neighbouring bands are less similar than the threshold."""
    return F.floor(F.log("n") / F.lit(-np.log(threshold).item())).cast("int")


def _buckets(reps: DataFrame, threshold: float) -> DataFrame:
    """(bucket, own, id, n): the rarest trigrams of each text, split by size band.

    Two sets more similar than the threshold share one of their n - ceil(t*n) + 1 rarest
    trigrams, and their sizes lie in the same or in neighbouring bands; a set is its own
    in one band and a guest in the next.
    """
    tokens = reps.select("id", "n", F.explode("grams").alias("gram"))
    frequency = tokens.groupBy("gram").agg(F.count("*").alias("f"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    ranked = tokens.join(frequency, "gram").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("rare"))
    prefix = ranked.withColumn("_band", _band(threshold)).select(
        "id", "n", "_band", F.explode(F.slice("rare", F.lit(1), keep.cast("int"))).alias("t"))
    seats = F.explode(F.array(
        F.struct(F.concat_ws("|", "t.gram", "_band").alias("bucket"), F.lit(True).alias("own")),
        F.struct(F.concat_ws("|", "t.gram", F.col("_band") + 1).alias("bucket"), F.lit(False).alias("own"))))
    return prefix.select("id", "n", seats.alias("seat")).select("seat.*", "id", "n")


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Exact similarity of distinct id pairs."""
    sets = reps.select("id", "grams")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("other"), F.col("grams").alias("_g")), "other")
    return both.select("id", "other", jaccard(F.col("grams"), F.col("_g")).alias("jaccard"))


def _hub_round(rows: DataFrame, sketches: DataFrame, reps: DataFrame, threshold: float, number: int, min_loose: int):
    """Compare the loose members of each crowded bucket with their smallest id.

    Seats stay narrow: a pair of member and hub meets the sketches once, however many buckets it shares.
    """
    hubs = rows.filter("explained = 0").groupBy("bucket").agg(F.min("id").alias("_hub"), F.count("*").alias("size")).filter(
        F.col("size") > min_loose).drop("size")
    asked = F.coalesce((F.col("explained") == 0) & F.col("_hub").isNotNull(), F.lit(False))
    faced = rows.join(hubs, "bucket", "left").withColumn("_asked", asked)
    pairs = faced.filter("_asked AND id <> _hub").select("id", "_hub").distinct()
    hub = sketches.select(*[F.col(c).alias(f"h_{c}") for c in sketches.columns])
    met = pairs.join(sketches, "id").join(hub, F.col("_hub") == F.col("h_id"))
    bits, sizes = _bits_apart(F.col, lambda c: F.col(f"h_{c}")), F.col("n") + F.col("h_n")
    compared = cut_lineage(met.select("id", "_hub", _may_qualify(bits, sizes, threshold).alias("_close"), ((sizes - bits) / (sizes + bits)).alias("_bound")))
    spokes = compared.filter("_close").select("id", F.col("_hub").alias("other"))
    star = cut_lineage(_verified(spread(spokes, "id"), reps))
    known = compared.drop("_close").join(star.withColumnRenamed("other", "_hub"), ["id", "_hub"], "left")
    judged = faced.join(known, ["id", "_hub"], "left")
    is_hub = F.col("id") == F.col("_hub")
    near = F.col("_asked") & F.coalesce(is_hub | (F.col("jaccard") > threshold), F.lit(False))
    distance = F.when(is_hub, F.lit(0.0)).otherwise(1 - F.coalesce("jaccard", "_bound"))
    judged = judged.withColumns({
        "explained": F.when(near, number).otherwise(F.col("explained")),
        "distance": distance if number == 1 else F.col("distance"),
    }).drop("_asked", "_bound", "_hub", "jaccard")
    return cut_lineage(judged), star.filter(F.col("jaccard") > threshold)


def _parts(left: np.ndarray, right: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """``labels`` with the parts that the pairs connect under one label, the smallest."""
    while (labels[left] != labels[right]).any():
        a, b = labels[left], labels[right]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def _kept(left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which pairs to keep so that each text has its smallest partner, and what all pairs connect stays connected."""
    best = np.full(len(rank), np.iinfo(np.int64).max)
    np.minimum.at(best, left, rank[right])
    np.minimum.at(best, right, rank[left])
    keep = (rank[right] == best[left]) | (rank[left] == best[right])
    labels = _parts(left[keep], right[keep], np.arange(len(rank)))
    while len(apart := np.flatnonzero(labels[left] != labels[right])):
        # One pair of each part that has one; every round at least halves the parts.
        chosen = apart[np.unique(labels[left[apart]], return_index=True)[1]]
        keep[chosen] = True
        labels = _parts(left[chosen], right[chosen], labels)
    return keep


class _Cell:
    """Trigram sets of some texts, of which the first ``middle`` are compared with the rest, or all with all if that is none."""

    def __init__(self, grams: np.ndarray, sizes: np.ndarray, middle: int):
        self.sizes, self.rows, self.middle = sizes, np.repeat(np.arange(len(sizes)), sizes), middle
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.codes, names = pd.factorize(grams)
        # Only trigrams of two texts, one of either side, can be shared.
        if middle < len(sizes):
            half = self.starts[middle]
            in_pair = [np.bincount(side, minlength=len(names)) > 0 for side in (self.codes[:half], self.codes[half:])]
            common = in_pair[0] & in_pair[1]
        else:
            common = np.bincount(self.codes, minlength=len(names)) > 1
        column = np.where(common, np.cumsum(common) - 1, -1)[self.codes]
        order = np.flatnonzero(column >= 0)
        order = order[np.argsort(column[order] // _PLANE, kind="stable")]
        self.at, self.column = self.rows[order], column[order]
        self.planes = np.searchsorted(self.column // _PLANE, np.arange(-(-int(common.sum()) // _PLANE) + 1))

    def sketches(self) -> np.ndarray:
        """One column of words for each text: the parities of its trigrams over so many bits."""
        words = np.empty((_SKETCH_BITS // 64, len(self.sizes)), dtype=np.uint64)
        for first in range(0, len(self.sizes), 512):
            last = min(first + 512, len(self.sizes))
            part = slice(self.starts[first], self.starts[last])
            odd = np.bincount((self.rows[part] - first) * _SKETCH_BITS + self.codes[part] % _SKETCH_BITS, minlength=(last - first) * _SKETCH_BITS) & 1
            words[:, first:last] = np.packbits(odd.astype(np.uint8).reshape(last - first, -1), axis=1).view(np.uint64).T
        return words

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Trigrams that the texts of each pair share."""
        out = np.zeros(len(left), dtype=np.int64)
        used = np.unique(np.concatenate([left, right]))
        place = np.full(len(self.sizes), -1)
        place[used] = np.arange(len(used))
        for plane, (start, end) in enumerate(zip(self.planes[:-1], self.planes[1:])):
            rows, columns = place[self.at[start:end]], self.column[start:end] - plane * _PLANE
            bits = np.empty((len(used), _PLANE // 64), dtype=np.uint64)
            cuts = np.argsort(rows, kind="stable")
            rows, columns = rows[cuts], columns[cuts]
            for first in range(0, len(used), 1024):
                last = min(first + 1024, len(used))
                a, b = np.searchsorted(rows, (first, last))
                dense = np.zeros((last - first, _PLANE), dtype=np.uint8)
                dense[rows[a:b] - first, columns[a:b]] = 1
                bits[first:last] = np.packbits(dense, axis=1).view(np.uint64)
            for first in range(0, len(left), 8192):
                pair = slice(first, first + 8192)
                out[pair] += np.bitwise_count(bits[place[left[pair]]] & bits[place[right[pair]]]).sum(axis=1, dtype=np.int64)
        return out

    def candidates(self, threshold: float):
        """Pairs that the sketches do not rule out, some at a time; texts of a side are in order of size."""
        sketches, sizes, end = self.sketches(), self.sizes, len(self.sizes)
        inside = self.middle == end
        others, low = (sizes, 0) if inside else (sizes[self.middle:], self.middle)
        slack = (1 - threshold) / (1 + threshold)
        for first in range(0, self.middle, 64):
            last = min(first + 64, self.middle)
            a = max(low + int(np.searchsorted(others, sizes[first] * threshold - 1e-6)), first + 1 if inside else 0)
            b = low + int(np.searchsorted(others, sizes[last - 1] / threshold + 1e-6, "right"))
            if a >= b:
                continue
            apart = np.zeros((last - first, b - a), dtype=np.uint16)
            for word in sketches:
                apart += np.bitwise_count(word[first:last, None] ^ word[None, a:b])
            x, y = np.nonzero(apart <= (sizes[first:last, None] + sizes[None, a:b]) * slack + 1e-9)
            x, y = x + first, y + a
            if inside:
                x, y = x[x < y], y[x < y]
            yield x, y


@F.pandas_udf(BinaryType())
def _packed(sets: pd.Series) -> pd.Series:
    """Ordered trigrams in an eighth of their bytes, as a text travels to many cells."""
    def pack(x: np.ndarray) -> bytes:
        points = np.concatenate([np.diff(x >> 42, prepend=0), x >> 21 & 0x1FFFFF, x & 0x1FFFFF]).astype("<u4")
        return zlib.compress(points.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)

    return sets.map(pack)


def _unpacked(packed: bytes) -> np.ndarray:
    points = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(3, -1).astype(np.int64)
    return np.cumsum(points[0]) << 42 | points[1] << 21 | points[2]


def _linked_cell(threshold: float):
    def linked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("right", "ascending"), ("n", "ascending")])
        ids, sizes = table["id"].combine_chunks(), table["n"].to_numpy().astype(np.int64)
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        grams = np.concatenate([_unpacked(x) for x in table["packed"].to_pylist()])
        cell = _Cell(grams, sizes, int((~table["right"].to_numpy()).sum()))
        found, waiting, held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0

        def verified():
            left, right = (np.concatenate(x) for x in zip(*waiting))
            differ = rank[left] != rank[right]
            left, right = left[differ], right[differ]
            both = cell.shared(left, right)
            similar = both / (sizes[left] + sizes[right] - both)
            hit = similar > threshold
            left, right, similar = (np.concatenate([old, new[hit]]) for old, new in zip(found, (left, right, similar)))
            keep = _kept(left, right, rank)
            return left[keep], right[keep], similar[keep]

        for pairs in cell.candidates(threshold):
            waiting.append(pairs)
            held += len(pairs[0])
            if held >= _CHECKED_PAIRS:
                found, waiting, held = verified(), [], 0
        if held:
            found = verified()
        left, right, similar = found
        swap = rank[left] > rank[right]
        low, high = np.where(swap, right, left), np.where(swap, left, right)
        return pa.table({"id": ids.take(pa.array(low)), "other": ids.take(pa.array(high)), "jaccard": pa.array(similar, pa.float64())})

    return linked


def _sizes(reps: DataFrame, threshold: float) -> dict[int, tuple[int, int]]:
    """Texts and trigrams of each size band."""
    rows = reps.groupBy(_band(threshold).alias("band")).agg(F.count("*").alias("texts"), F.sum("n").alias("grams")).collect()
    return {r["band"]: (r["texts"], r["grams"]) for r in sorted(rows)}


def _pairs_of_like_size(bands: dict[int, tuple[int, int]]) -> int:
    return sum(texts * (texts - 1) // 2 + texts * bands.get(band + 1, (0, 0))[0] for band, (texts, _) in bands.items())


def blocked_links(reps: DataFrame, threshold: float, bands: dict[int, tuple[int, int]], block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """The links of ``representative_links``, by comparing all texts of the same and of neighbouring size bands.

    A band is dealt over blocks of bounded rows and trigrams, and every two blocks that may hold partners meet in
    a cell. A cell returns no more links than it has texts and parts, never its pairs.
    """
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = min(block_rows, int(max(_CELL_PAIRS, _pairs_of_like_size(bands) // (8 * parts)) ** 0.5))
    blocks = {band: max(-(-texts // rows), -(-grams // _BLOCK_GRAMS)) for band, (texts, grams) in bands.items()}
    cells = [((band, i), (band, j)) for band, n in blocks.items() for i in range(n) for j in range(i, n)]
    cells += [((band, i), (band + 1, j)) for band, n in blocks.items() for i in range(n) for j in range(blocks.get(band + 1, 0))]
    seats = [(*left, number, False) for number, (left, _) in enumerate(cells)]
    seats += [(*right, number, True) for number, (left, right) in enumerate(cells) if left != right]
    if not cells:
        return reps.select("id", F.col("id").alias("other"), F.lit(0.0).alias("jaccard")).limit(0)
    seats = reps.sparkSession.createDataFrame(seats, "band int, block int, cell int, right boolean")
    count = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    placed = reps.select("id", "n", _packed("grams").alias("packed"), _band(threshold).alias("band")).withColumn("block", F.pmod(F.xxhash64("id", "n"), count[F.col("band")]).cast("int"))
    rows = placed.join(seats, ["band", "block"]).select("cell", "right", "id", "n", "packed")
    kind = reps.schema["id"].dataType.simpleString()
    found = rows.repartition(max(parts, min(len(cells), 4096)), "cell").groupBy("cell").applyInArrow(
        _linked_cell(threshold), f"id {kind}, other {kind}, jaccard double")
    return found.dropDuplicates(["id", "other"])


def representative_links(reps: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Links (id, other, jaccard), id < other, between distinct texts above the threshold.

    The links connect exactly the texts the full pair list would connect, and hold each
    text's smallest partner.
    """
    bands = _sizes(reps, threshold)
    if _pairs_of_like_size(bands) <= _BUCKET_GRAM * sum(grams for _, grams in bands.values()):
        return blocked_links(reps, threshold, bands)
    links = bucketed_links(reps, threshold, block_rows, _pairs_of_like_size(bands))
    return blocked_links(reps, threshold, bands) if links is None else links


def bucketed_links(reps: DataFrame, threshold: float, block_rows: int, most_pairs: float = float("inf")) -> DataFrame | None:
    """The links of ``representative_links`` by buckets and hubs; nothing if ``most_pairs`` in cells cost less than what the hubs leave over."""
    buckets, sketches = _buckets(reps, threshold), cut_lineage(_sketches(reps))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("_size"), F.max("own").alias("_any_own"))
    # Seats of a crowded bucket lie in many parts; its hub is sent to each of them.
    rows = spread(buckets.join(shared.filter("_size > 1 AND _any_own").select("bucket"), "bucket"), "bucket", "id")
    rows = cut_lineage(rows.withColumns({"explained": F.lit(0), "distance": F.lit(None).cast("double")}))
    rows, star = _hub_round(rows, sketches, reps, threshold, 1, 1)
    links = [star]
    for number in range(2, _MAX_HUB_ROUNDS + 1):
        # Later hubs look at the crowded buckets only; the rest is settled by pairs below.
        crowded = cut_lineage(
            rows.filter("explained = 0").groupBy("bucket").agg(F.count("*").alias("_size"))
            .filter(F.col("_size") > block_rows).select("bucket"))
        if crowded.isEmpty():
            break
        inside, star = _hub_round(rows.join(crowded, "bucket", "left_semi"), sketches, reps, threshold, number, block_rows)
        rows = rows.join(crowded, "bucket", "left_anti").unionByName(inside)
        links.append(star)
    links = [s.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "jaccard") for s in links]

    # Distance is a metric: a partner of an unexplained member lies about as far out.
    slack = F.lit(1 - threshold + 1e-9)
    active = rows.groupBy("bucket").agg(
        F.min(F.when(F.col("explained") != 1, F.col("distance"))).alias("_edge"),
        F.count_if(F.col("explained") != 1).alias("_outside"), F.count("*").alias("n_all")).filter("_outside > 0")
    rest = rows.join(active, "bucket").filter((F.col("explained") != 1) | (F.col("distance") > F.col("_edge") - slack))
    left_over = rest.groupBy("bucket").agg((F.count_if(F.col("explained") != 1) * F.count("*")).cast("double").alias("pairs"))
    if (left_over.agg(F.sum("pairs")).first()[0] or 0) * _BUCKET_PAIR > most_pairs:
        return None
    rest = rest.join(sketches.drop("n"), "id")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_all") / block_rows)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    keep = ["bucket", "own", "id", "n", "explained", "distance", *_SKETCH]
    cell = ("bucket", "row", "col")
    x = spread(rest.filter("explained <> 1").select(*keep, block.alias("row"), every.alias("col")), *cell).alias("x")
    y = spread(rest.select(*keep, block.alias("col"), every.alias("row")), *cell).alias("y")
    same_cell = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.col") == F.col("y.col"))
    once = F.when(F.col("y.explained") == 1, F.col("x.distance") - F.col("y.distance") < slack).otherwise(
        (F.col("x.id") < F.col("y.id")) & ((F.col("x.explained") == 0) | (F.col("x.explained") != F.col("y.explained"))))
    sizes = F.col("x.n") + F.col("y.n")
    bits = _bits_apart(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    pairs = x.join(y, same_cell & (F.col("x.own") | F.col("y.own")) & once & _may_qualify(bits, sizes, threshold)).select(
        F.least("x.id", "y.id").alias("id"), F.greatest("x.id", "y.id").alias("other")).distinct()
    links.append(_verified(spread(pairs, "id"), reps).filter(F.col("jaccard") > threshold).select("id", "other", "jaccard"))
    return reduce(DataFrame.unionByName, links).dropDuplicates(["id", "other"])


def near_duplicate_links(
    texts: DataFrame, threshold: float = C.CLUSTER_MIN_JACCARD, block_rows: int = C.SCALE.similarity_block_rows
) -> tuple[DataFrame, DataFrame]:
    """Links between representatives, and (id, rep) for every comparable row of ``texts``."""
    reps, members = _representatives(texts)
    reps = cut_lineage(_gram_sets(spread(reps.filter("id IS NOT NULL"), "id")))
    return cut_lineage(representative_links(reps, threshold, block_rows)), members


def first_near_duplicate(links: DataFrame, members: DataFrame) -> DataFrame:
    """For each row the smallest id of an earlier row above the threshold, if any."""
    both = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"), "jaccard"))
    smallest = both.groupBy("id").agg(F.min(F.struct("other", "jaccard")).alias("m")).select(
        F.col("id").alias("rep"), F.col("m.other").alias("near_id"), F.col("m.jaccard").alias("near_jaccard"))
    found = members.join(smallest, "rep", "left")
    own_copy = F.when(F.col("rep") < F.col("id"), F.struct(F.col("rep").alias("first_id"), F.lit(1.0).alias("jaccard")))
    near = F.when(F.col("near_id") < F.col("id"), F.struct(F.col("near_id").alias("first_id"), F.col("near_jaccard").alias("jaccard")))
    return found.select("id", F.least(own_copy, near).alias("f")).filter("f IS NOT NULL").select("id", "f.first_id", "f.jaccard")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest id of each component.

    Alternating star contraction: every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour. The number of rounds grows with the logarithm of the
    component size; each round ends in a reliable checkpoint.
    """
    edges = cut_lineage(
        links.select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).filter("lo <> hi").distinct())
    def mark(e: DataFrame) -> tuple:
        # Equal sets of edges have equal counts and sums; a settled set is not worth two set differences.
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.sum(F.hash("hi", "lo").cast("long"))).first())

    seen = mark(edges)
    for _ in range(max_rounds):
        around = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        smallest = around.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = around.filter("v > u").join(smallest, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = cut_lineage(large.filter("lo <> hi").distinct())
        down = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(down, "u")
        contracted = small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).unionByName(
            down.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        after = cut_lineage(contracted.filter("lo <> hi").distinct())
        before, seen, edges = seen, mark(after), after
        if seen == before:
            break
    else:
        raise RuntimeError("component contraction did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def extend_components(stored: DataFrame, links: DataFrame) -> DataFrame:
    """``stored`` (node, root) with the components that new ``links`` (id, other) join or begin.

    Only components that a new link touches are contracted: the links are lifted to the roots of their
    ends, the roots are joined, and the nodes below a root that lost its place take the new one. ``stored``
    holds every node of earlier links; the result is what all links together would give.
    """
    ends = links.select("id", "other").filter("id <> other")
    nodes = ends.select(F.col("id").alias("node")).unionByName(ends.select(F.col("other").alias("node"))).distinct()
    known = cut_lineage(nodes.join(stored, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("fresh")))
    at = lambda name: known.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    lifted = ends.join(at("id"), "id").join(at("other"), "other").select(F.col("id_root").alias("id"), F.col("other_root").alias("other"))
    moved = connected_components(lifted).filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_new"))
    rows = stored.unionByName(known.filter("fresh").select("node", "root"))
    return rows.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))


def near_duplicate_clusters(texts: DataFrame, threshold: float = C.CLUSTER_MIN_JACCARD, **scale) -> DataFrame:
    """(id, root, cluster_number) for rows in clusters of two or more.

    ``texts`` has id, text and position. Numbers follow the id of the first member in file
    order, which need not be the smallest id.
    """
    links, members = near_duplicate_links(texts.select("id", "text"), threshold, **scale)
    roots = connected_components(links).withColumnRenamed("node", "rep")
    placed = members.join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    placed = placed.join(texts.select("id", "position"), "id")
    clusters = placed.groupBy("root").agg(F.count("*").alias("n"), F.min_by("id", "position").alias("leader")).filter("n > 1")
    return placed.join(number_in_order(clusters, "leader", "cluster_number"), "root").select("id", "root", "leader", "cluster_number")


def number_in_order(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based position of each row by ``key``, without a single-task window.

    Rows are range-partitioned and sorted; a running count of the partition sizes gives
    each partition its offset.
    """
    ordered = cut_lineage(
        df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
        .withColumn("_o", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_o").alias("first")).orderBy("_p").collect()
    offset, rows = 0, []
    for size in sizes:
        rows.append((size["_p"], offset + 1 - size["first"]))
        offset += size["n"]
    shift = F.create_map(*[F.lit(x) for pair in rows for x in pair]) if rows else F.lit(None).cast("map<int,bigint>")
    return ordered.withColumn(name, F.col("_o") + F.try_element_at(shift, F.col("_p"))).drop("_p", "_o")
