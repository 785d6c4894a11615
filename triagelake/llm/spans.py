"""Substring dedup over sliding runs of sentences.

For every sentence the shortest runs of consecutive sentences with at least ``min_words`` words that
start and that end there are hashed: 128 bits over the 128-bit hashes of its sentences' words. A run
depends on nothing around it, so a passage gives the same runs wherever it stands, and together they
cover what all runs of so many words would. Runs meet in one global aggregate; where a run is in
several documents, or again in the same one, the sentences of every occurrence but the first are
covered and go. Of a passage that begins or ends inside a sentence, that sentence stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from triagelake.llm.common import saved, slices

#: Words of a run. One sentence of so many words is a run by itself.
MIN_WORDS = 20
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"\w+")


def sentences(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest of the lower-cased words) of the sentences that have a word."""
    out, find, digest = [], _WORD.findall, xxhash.xxh3_128_digest
    for match in _SENTENCE.finditer(text or ""):
        words = find(match.group().lower())
        if words:
            out.append((*match.span(), len(words), digest(" ".join(words).encode("utf-8", "surrogatepass"))))
    return out


def runs(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the runs from and up to each sentence, in code points, by their end."""
    found = sentences(text)
    chain = b"".join([d for _, _, _, d in found])
    first, held, fresh = 0, 0, 0  # fresh: the first sentence from which no run has come
    for last, (_, end, own, _) in enumerate(found):
        held += own
        while held - found[first][2] >= min_words:
            held -= found[first][2]
            first += 1
        if held >= min_words:
            for at in range(min(fresh, first), first + 1):
                yield found[at][0], end, xxhash.xxh3_128_digest(chain[16 * at:16 * last + 16])
            fresh = first + 1


def _runs(min_words: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for ids, texts in slices(batches):
            docs, digests, starts, ends, again = [], [], [], [], []
            for doc, text in zip(ids, texts):
                if doc is None:
                    continue
                seen = set()
                for start, end, digest in runs(text, min_words):
                    docs.append(doc)
                    digests.append(digest)
                    starts.append(start)
                    ends.append(end)
                    again.append(digest in seen)
                    seen.add(digest)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = (docs, halves[:, 0], halves[:, 1], starts, ends, again)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "h1", "h2", "start", "end", "again"])

    return emit


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, start, end, first_doc) of every run that is not the first of its kind.

    First is the smallest id, then the earliest place. Rows of one id count as one document; rows
    without an id are left alone.
    """
    found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        _runs(min_words), "doc long, h1 long, h2 long, start long, end long, again boolean")
    shared = saved(found.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.max("again").alias("twice"))
                   .where("first_doc < last_doc OR twice").select("h1", "h2", "first_doc"))
    return (found.join(shared, ["h1", "h2"]).where("doc > first_doc OR again")
            .select("doc", "start", "end", "first_doc"))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, cuts, first_docs): the covered stretches of each document that has any, merged and in order."""
    grouped = repeated_runs(docs, id_col, text_col, min_words).groupBy("doc").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    cut = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, all_runs, firsts in slices(batches):
            out = []
            for one in all_runs:
                cuts: list[dict] = []
                for run in one:
                    if cuts and run["start"] <= cuts[-1]["end"]:
                        cuts[-1]["end"] = max(cuts[-1]["end"], run["end"])
                    else:
                        cuts.append(dict(run))
                out.append(cuts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, cut), pa.array(firsts, pa.list_(pa.int64()))],
                                             ["doc", "cuts", "first_docs"])

    return grouped.mapInArrow(merge, "doc long, cuts array<struct<start:long,end:long>>, first_docs array<long>")


@F.pandas_udf(StringType())
def _left(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without the stretches between starts and ends, in one sweep."""
    out = []
    for text, first, last in zip(texts, starts, ends):
        if text is not None and first is not None:
            text = "".join(text[a:b] for a, b in zip([0, *last], [*first, len(text)]))
        out.append(text)
    return pd.Series(out, dtype=object)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, covered sentences cut out of the text; ``n_cut`` characters went.

    Null and empty texts and texts of fewer words than a run stay as they are. Rows without an id keep
    their text. An empty table gives an empty table. A column named ``n_cut`` is replaced.
    """
    cuts = covered(docs, id_col, text_col, min_words).select(F.col("doc").alias("__llm_doc"), F.col("cuts").alias("__llm_cuts"))
    text, touched = F.col(text_col), F.col("__llm_cuts").isNotNull()
    left = _left(F.when(touched, text), F.transform("__llm_cuts", lambda c: c["start"]), F.transform("__llm_cuts", lambda c: c["end"]))
    gone = F.aggregate("__llm_cuts", F.lit(0).cast("long"), lambda a, c: a + c["end"] - c["start"])
    return (docs.join(cuts, F.col(id_col).cast("long") == F.col("__llm_doc"), "left")
            .withColumns({"n_cut": F.coalesce(gone, F.lit(0).cast("long")),
                          text_col: F.when(touched, left).otherwise(text)})
            .drop("__llm_doc", "__llm_cuts"))
