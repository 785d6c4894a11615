"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary goes into a blocked Bloom filter that is sharded by word length: the shards lie one
after the other in one array of 64-bit blocks. Each word's edits are generated, replacements by a
greater character and deletions, so that every pair of words one edit apart comes up exactly once, and
are probed in their length's shard. Only edits the filter knows shuffle, to an exact join with the
vocabulary, so a false alarm costs a row and never a wrong result.

A stretch of the array of bounded size is broadcast at a time; a larger vocabulary takes more passes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from triagelake.llm.common import saved, slices
from triagelake.session import spread

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of a filter block on average, and the fewest blocks of a length.
LOAD, LEAST = 2, 64
#: Blocks (8 bytes each) of the filter that one pass broadcasts.
PASS_BLOCKS = 2_000_000
#: Words that one task counts before it hands them on, and edits that it probes at a time.
HELD, PROBES = 300_000, 1_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_BITS = 5


def damaged(word: bytes, seed: int, every: int) -> bytes:
    """The word, or without one of its characters if ``every`` divides its hash after ``seed``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, damage_every: int = 0) -> DataFrame:
    """(word, n): how often each word of ``min_chars`` letters or more occurs, A-Z lowered.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF. ``damage_every`` plants errors: a word of a document
    loses a character if the hash of "id:word" is divisible by it.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for ids, texts in slices(batches):
            for doc, text in zip(ids, texts):
                if not text:
                    continue
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(text.encode("latin-1", "replace").translate(_FOLD).split()).items():
                    if len(word) >= min_chars:
                        if damage_every:
                            word = damaged(word, seed, damage_every)
                            if len(word) < min_chars:
                                continue
                        held[word] += n
            if len(held) >= HELD:
                yield handed_on()
        yield handed_on()

    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(at: int | np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The hash of each letter at its place; a word's hash is their sum."""
    place = np.atleast_1d(np.asarray(at, np.uint64)) + np.uint64(1)
    return _mixed(place * np.uint64(0x9E3779B97F4A7C15) + letter.astype(np.uint64))


class Shards:
    """Where each length's blocks begin, and how many there are."""

    def __init__(self, words: dict[int, int]):
        self.first: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        self.total = 0
        for length, n in sorted(words.items()):
            self.first[length], self.blocks[length] = self.total, max(LEAST, -(-n // LOAD))
            self.total += self.blocks[length]

    def places(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash, and the hash of which bits it sets there."""
        bits = _mixed(hashes)
        return np.int64(self.first[length]) + ((bits >> np.uint64(32)) * np.uint64(self.blocks[length]) >> np.uint64(32)).astype(np.int64), bits


def _set_bits(bits: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(bits), np.uint64)
    for k in range(_BITS):
        mask |= np.uint64(1) << (bits >> np.uint64(6 * k) & np.uint64(63))
    return mask


def _by_length(words: Iterable[str]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(length, which words, their letters as a matrix) of words in Latin-1."""
    groups: dict[int, list[int]] = {}
    raw = [w.encode("latin-1") for w in words]
    for k, w in enumerate(raw):
        groups.setdefault(len(w), []).append(k)
    for length, which in groups.items():
        rows = max(1, PROBES // (length * 90))
        for at in range(0, len(which), rows):
            part = which[at:at + rows]
            yield length, part, np.frombuffer(b"".join(raw[k] for k in part), np.uint8).reshape(len(part), length)


def filter_words(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """(block, bits): the filter's blocks that are not empty."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (words,) in slices(batches, 4096):
            for length, _, letters in _by_length(words):
                hashes = _letters(np.arange(length), letters).sum(axis=1, dtype=np.uint64)
                block, bits = shards.places(length, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(_set_bits(bits).view(np.int64))], ["block", "bits"])

    return vocabulary.select("word").mapInArrow(places, "block long, bits long").groupBy("block").agg(F.expr("bit_or(bits)").alias("bits"))


class Filter:
    """The blocks of one pass."""

    def __init__(self, shards: Shards, low: int, blocks: np.ndarray):
        self.shards, self.low, self.blocks = shards, low, blocks

    def reaches(self, length: int) -> bool:
        first = self.shards.first.get(length)
        return first is not None and first < self.low + len(self.blocks) and first + self.shards.blocks[length] > self.low

    def known(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes the shard of ``length`` may hold, as far as this pass has it."""
        block, bits = self.shards.places(length, hashes)
        block -= self.low
        here = np.flatnonzero((block >= 0) & (block < len(self.blocks)))
        held, bits = self.blocks[block[here]], bits[here]
        for k in range(_BITS):
            hit = np.flatnonzero(held >> (bits >> np.uint64(6 * k) & np.uint64(63)) & np.uint64(1))
            here, held, bits = here[hit], held[hit], bits[hit]
        return here


def edits(words: list[str], filter_: Filter, alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """(which word, edit) of the edits that the filter may know: greater letters put in, letters left out."""
    for length, which, letters in _by_length(words):
        own = length and filter_.reaches(length)
        shorter = length > 1 and filter_.reaches(length - 1)
        if not own and not shorter:
            continue
        raw = letters.tobytes()
        whole = np.zeros(len(which), np.uint64)
        after = np.zeros(len(which), np.uint64)
        for at in range(length):
            whole += _letters(at, letters[:, at])
            if at:
                after += _letters(at - 1, letters[:, at])
        before = np.zeros(len(which), np.uint64)
        for at in range(length):
            here = _letters(at, letters[:, at])
            if own:
                row, new = np.nonzero(letters[:, at, None] < alphabet)
                hashes = (whole - here)[row] + _letters(at, alphabet)[new]
                for k in filter_.known(length, hashes):
                    word = raw[row[k] * length:(row[k] + 1) * length]
                    yield which[row[k]], (word[:at] + bytes([alphabet[new[k]]]) + word[at + 1:]).decode("latin-1")
            if at:
                after -= _letters(at - 1, letters[:, at])
            if shorter:
                # Of equal letters in a row the first one goes; the others give the same word.
                row = np.flatnonzero(letters[:, at] != letters[:, at - 1]) if at else np.arange(len(which))
                for k in filter_.known(length - 1, (before + after)[row]):
                    word = raw[row[k] * length:(row[k] + 1) * length]
                    yield which[row[k]], (word[:at] + word[at + 1:]).decode("latin-1")
            before += here


def near_pairs(vocabulary: DataFrame, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(a, a_n, b, b_n): every two words of (word, n) that differ by one character, once.

    ``vocabulary`` must be saved and its words distinct. Words with other characters than a-z and U+00C0
    to U+00FF are near no word.
    """
    spark = vocabulary.sparkSession
    vocabulary = vocabulary.where(F.col("word").rlike("^[a-z\u00C0-\u00FF]+\\z"))
    lengths = {r["length"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    shards = Shards(lengths)
    alphabet = np.array([*range(97, 123), *range(192, 256)], np.uint8)
    blocks = saved(filter_words(vocabulary, shards))
    found = spark.createDataFrame([], "a string, a_n long, edit string")
    for low in range(0, shards.total, pass_blocks):
        size = min(pass_blocks, shards.total - low)
        rows = blocks.where((F.col("block") >= low) & (F.col("block") < low + size)).toArrow()
        dense = np.zeros(size, np.uint64)
        dense[rows.column("block").to_numpy() - low] = rows.column("bits").to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(Filter(shards, low, dense))

        def probe(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for words, n in slices(batches, 4096):
                some: list[tuple[str, int, str]] = []
                for k, edit in edits(words, shared.value, alphabet):
                    some.append((words[k], n[k], edit))
                    if len(some) * (len(edit) + 16) > 4_000_000:
                        yield _rows(some)
                        some = []
                yield _rows(some)

        found = found.unionByName(spread(vocabulary.select("word", "n"), "word").mapInArrow(probe, "a string, a_n long, edit string"))
    return found.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), F.col("edit") == F.col("b")).drop("edit")


def _rows(some: list[tuple[str, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*some)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["a", "a_n", "edit"])


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary`` (word, n).

    Two words are near if they differ by one inserted, deleted or replaced character. A word's form is
    its near word of largest n (ties: the smallest in code-point order) if that has ``ratio`` times its
    own n at least. The root is the last of the forms one after the other, or the word itself. Null words
    and counts go; a word given twice counts once, with the sum. An empty table gives no rows.
    ``ratio`` must be 2 at least.
    """
    vocabulary = saved(vocabulary.where("word IS NOT NULL AND n > 0").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = saved(near_pairs(vocabulary, pass_blocks))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = sides.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    told = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    formed = F.col("near_n") >= ratio * F.col("n")
    told = saved(told.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    # Each step at least doubles n, so 64 steps reach any root, and six doublings make them.
    roots = saved(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(6):
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = saved(roots.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
             damage_every: int = 0) -> DataFrame:
    """Spelling variants among the words of whole texts; see ``word_counts`` and ``group_variants``.

    Null and empty texts have no words, a null id hashes as an empty one. Repeated rows count each time.
    Other columns are not read. Words rarer than ``min_count`` are left out.
    """
    return group_variants(word_counts(docs, id_col, text_col, min_chars, damage_every).where(F.col("n") >= min_count))
