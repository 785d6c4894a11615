"""Ranked evidence and near-duplicate history for each message.

Every message is scored against the earlier history of its recipient. The pairs of one
recipient are laid out as a grid of bounded cells: a recipient with more rows than a block
gets several history and message blocks, so no task grows with the recipient. A cell never
emits its pairs; it returns the few best rows per message as lists and two running figures,
which are merged afterwards for messages that have several cells.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from triagelake import config as C
from triagelake.functions.text import normalise_text
from triagelake.session import spread

FLAG_NAMES = ("opened", "replied", "dismissed", "muted_after", "reported")
_DAY_US = 86400000000.0
_VOCAB_CHUNK = 4096
_CELL_KEYS = ["user_id", "cell_m", "cell_h"]

_ENTRY = """
    _by_value: double, _by_time: bigint, history_message_id: string, score: double, same_peer: boolean, same_group: boolean,
    jaccard: double, event_relevance: double, recency: double, created_at: timestamp_ntz, days_ago: double,
    conversation_type: string, peer_id: string, text_excerpt: string, opened: boolean, replied: boolean,
    dismissed: boolean, muted_after: boolean, reported: boolean
"""
_CELL_SCHEMA = f"message_id string, max_jaccard double, n_duplicates long, evidence array<struct<{_ENTRY}>>, near_duplicates array<struct<{_ENTRY}>>"
_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_ENTRY_TYPES = [(name, _ARROW[kind]) for name, kind in (part.split(": ") for part in " ".join(_ENTRY.split()).split(", "))]


class _GramSets:
    """Trigram sets of distinct texts as numbers, one after the other."""

    def __init__(self, texts):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        n = np.maximum(lengths - 2, 0)
        of = np.repeat(np.arange(len(lengths)), n)
        at = np.arange(len(of)) + np.repeat((np.cumsum(lengths) - lengths) - (np.cumsum(n) - n), n)
        # A code point has 21 bits, so three of them are one number.
        numbers, grams = pd.factorize(points[at] << 42 | points[at + 1] << 21 | points[at + 2])
        self.vocabulary = len(grams)
        # Distinct in order of appearance, so texts stay one after the other.
        of, self.numbers = np.divmod(pd.unique(of * max(len(grams), 1) + numbers), max(len(grams), 1))
        self.sizes = np.bincount(of, minlength=len(lengths)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _items(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[texts]
        rows = np.repeat(np.arange(len(texts)), n)
        return rows, self.numbers[np.arange(len(rows)) + np.repeat(self.starts[texts] - (np.cumsum(n) - n), n)]

    def jaccard(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Similarity of every left text with every right one; NaN where a side is empty."""
        lefts, left_of = np.unique(left, return_inverse=True)
        rights, right_of = np.unique(right, return_inverse=True)
        sides = self._items(lefts), self._items(rights)
        # Only trigrams of both sides can be shared.
        found = np.zeros((2, self.vocabulary), dtype=bool)
        for seen, (_, grams) in zip(found, sides):
            seen[grams] = True
        shared = np.flatnonzero(found[0] & found[1])
        column = np.full(self.vocabulary, -1, dtype=np.int64)
        column[shared] = np.arange(len(shared))
        both = np.zeros((len(lefts), len(rights)), dtype=np.float32)
        for start in range(0, len(shared), _VOCAB_CHUNK):
            width = min(_VOCAB_CHUNK, len(shared) - start)
            planes = []
            for (rows, grams), side in zip(sides, (lefts, rights)):
                plane, cols = np.zeros((len(side), width), dtype=np.float32), column[grams]
                inside = (cols >= start) & (cols < start + width)
                plane[rows[inside], cols[inside] - start] = 1.0
                planes.append(plane)
            both += planes[0] @ planes[1].T
        n_left, n_right = self.sizes[lefts].astype(np.float64)[:, None], self.sizes[rights].astype(np.float64)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            unique = np.where((n_left > 0) & (n_right > 0), both / (n_left + n_right - both), np.nan)
        return unique[np.ix_(left_of.ravel(), right_of.ravel())]


def _codes(values: pd.Series) -> np.ndarray:
    """A number for each value, below zero for a missing one, which equals nothing."""
    return pd.factorize(values)[0]


def _whole_cells(batches):
    """Rows sorted by cell in frames of whole cells; a cell that is longer than a batch is a frame of its own."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        cell = _cell_numbers(pd.concat([*[h.tail(1) for h in held[-1:]], batch], ignore_index=True))
        goes_on, cell = bool(held) and cell[0] == cell[1], cell[-len(batch):]
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut or not goes_on:
            done = [*held, batch.iloc[:cut]]
            if sum(map(len, done)):
                yield pd.concat(done, ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _cell_numbers(rows: pd.DataFrame) -> np.ndarray:
    """The number of each row's cell, for rows sorted by cell."""
    keys = np.stack([pd.factorize(rows[c], use_na_sentinel=False)[0] for c in _CELL_KEYS])
    return np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(axis=0).cumsum()])


def _cell_ranker(k_evidence: int, k_near: int, min_score: float, min_jaccard: float):
    def rank(rows: pd.DataFrame) -> pa.RecordBatch | None:
        # Messages first. Ties go to the newest row, then to the smallest id, which this order provides.
        cell, ids = _cell_numbers(rows), pd.factorize(rows["message_id"], sort=True)[0]
        order = np.lexsort((np.where(ids < 0, len(rows), ids), -rows["at_us"].to_numpy(), ~rows["is_message"].to_numpy(dtype=bool), cell))
        rows, cell = rows.iloc[order].reset_index(drop=True), cell[order]
        # A missing text shares no trigram with any other, like an empty one.
        text_of, texts = pd.factorize(rows["words"].fillna(""))
        sets, at = _GramSets(texts), rows["at_us"].to_numpy()
        peers, groups = _codes(rows["peer_id"]), _codes(rows["group_key"])
        reaction = np.max(
            [np.where(rows[f].to_numpy(dtype=bool), C.EVENT_RELEVANCE[f], 0.0) for f in FLAG_NAMES], axis=0
        )
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        n_messages = np.add.reduceat(rows["is_message"].to_numpy(dtype=np.int64), starts)
        summaries, winners = [], {"evidence": [], "near": []}

        def best(kind: str, first: int, middle: int, value: np.ndarray, keep: np.ndarray, k: int, figures: dict) -> None:
            columns = np.argsort(-np.where(keep, value, -np.inf), axis=1, kind="stable")[:, :k]
            asked = np.repeat(np.arange(len(value)), columns.shape[1])
            columns = columns.ravel()
            chosen = keep[asked, columns]
            asked, columns = asked[chosen], columns[chosen]
            if len(asked):
                winners[kind].append({"_m": asked + first, "_h": columns + middle, "score": value[asked, columns],
                                      **{name: x[asked, columns] for name, x in figures.items()}})

        for first, n, end in zip(starts, n_messages, [*starts[1:], len(rows)]):
            middle = first + n
            if middle == first or middle == end:
                continue
            m, h = slice(first, middle), slice(middle, end)
            earlier = at[h][None, :] < at[m][:, None]
            sim = np.where(earlier, sets.jaccard(text_of[m], text_of[h]), np.nan)
            lexical = np.nan_to_num(sim, nan=0.0)
            days = (at[m][:, None] - at[h][None, :]) / _DAY_US
            recent = 0.5 ** (np.maximum(days, 0.0) / C.RECENCY_HALF_LIFE_DAYS)
            peer = (peers[m][:, None] == peers[h][None, :]) & (peers[m][:, None] >= 0)
            group = (groups[m][:, None] == groups[h][None, :]) & (groups[m][:, None] >= 0)
            score = (
                C.W_SAME_PEER * peer + C.W_LEXICAL * lexical + C.W_SAME_GROUP * group
                + C.W_EVENT * reaction[h][None, :] + C.W_RECENCY * recent
            )
            near = sim >= min_jaccard
            none, top = np.isnan(sim).all(axis=1), np.nanmax(np.nan_to_num(sim, nan=-1.0), axis=1)
            summaries.append((np.arange(first, middle), np.where(none, np.nan, top), near.sum(axis=1)))
            figures = {"jaccard": lexical, "same_peer": peer, "same_group": group, "recency": recent, "days_ago": days}
            best("evidence", first, middle, score, earlier & (score >= min_score), k_evidence, figures)
            best("near", first, middle, lexical, near, k_near, figures)
        if not summaries:
            return None
        asked, top, counts = (np.concatenate(x) for x in zip(*summaries))
        ids, others, types = (pa.array(rows[c], pa.string(), from_pandas=True) for c in ("message_id", "peer_id", "conversation_type"))
        excerpts = pc.utf8_slice_codeunits(pa.array(rows["words"], pa.string(), from_pandas=True), 0, 160)
        flags = {f: rows[f].to_numpy(dtype=bool) for f in FLAG_NAMES}

        def ranked(kind: str) -> pa.Array:
            """The entries of every message as one list, in ranking order."""
            if not winners[kind]:
                return pa.nulls(len(asked), pa.list_(pa.struct([pa.field(n, t) for n, t in _ENTRY_TYPES])))
            found = {name: np.concatenate([w[name] for w in winners[kind]]) for name in winners[kind][0]}
            places, times = found["_h"], at[found["_h"]].astype(np.int64)
            found |= {
                "_by_value": -found["score"], "_by_time": -times, "history_message_id": ids.take(pa.array(places)),
                "event_relevance": reaction[places], "created_at": pa.array(times).cast(pa.timestamp("us")),
                "conversation_type": types.take(pa.array(places)), "peer_id": others.take(pa.array(places)),
                "text_excerpt": excerpts.take(pa.array(places)), **{f: flag[places] for f, flag in flags.items()},
            }
            entries = pa.StructArray.from_arrays([pa.array(found[n], t) for n, t in _ENTRY_TYPES], [n for n, _ in _ENTRY_TYPES])
            # Messages and winners come in the same order, so a message's entries lie side by side.
            per_row = np.bincount(found["_m"], minlength=len(rows))[asked]
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], per_row.cumsum()]), pa.int32()), entries)

        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(asked)), pa.array(top, pa.float64(), from_pandas=True), pa.array(counts, pa.int64()), ranked("evidence"), ranked("near")],
            ["message_id", "max_jaccard", "n_duplicates", "evidence", "near_duplicates"])

    def rank_cells(batches):
        for rows in _whole_cells(batch.to_pandas() for batch in batches):
            found = rank(rows)
            if found is not None:
                yield found

    return rank_cells


def _side(df: DataFrame, is_message: bool) -> DataFrame:
    """Both sides of the grid in one shape; group membership counts only in group chats."""
    flags = {f: (F.lit(False) if is_message else F.col(f)) for f in FLAG_NAMES}
    return df.select(
        "user_id", "message_id", F.lit(is_message).alias("is_message"), "at_us", "peer_id",
        F.when(F.col("conversation_type") == "group", F.col("group_id")).alias("group_key"),
        "conversation_type", normalise_text(F.col("message_text")).alias("words"),
        *[c.alias(n) for n, c in flags.items()],
    )


def rank_history(
    messages: DataFrame,
    history: DataFrame,
    k_evidence: int = C.EVIDENCE_TOP_K,
    k_near: int = C.NEAR_DUPLICATE_TOP_K,
    block_rows: int = C.SCALE.pair_block_rows,
) -> DataFrame:
    """One row per message: ``evidence``, ``near_duplicates``, ``max_jaccard``, ``duplicate_count``.

    ``messages`` and ``history`` carry ``peer_id`` and ``at_us``; ``history`` also the event
    flags. Messages without earlier history get empty lists.
    """
    m, h = _side(messages, True), _side(history, False)
    # Only recipients above one block appear here; the rest use a single cell.
    sizes = (
        m.select("user_id", F.lit(1).alias("n_m"), F.lit(0).alias("n_h"))
        .unionByName(h.select("user_id", F.lit(0).alias("n_m"), F.lit(1).alias("n_h")))
        .groupBy("user_id").agg(F.sum("n_m").alias("n_m"), F.sum("n_h").alias("n_h"))
        .filter((F.col("n_m") > block_rows) | (F.col("n_h") > block_rows))
        .select("user_id", F.ceil(F.col("n_m") / block_rows).alias("s_m"), F.ceil(F.col("n_h") / block_rows).alias("s_h"))
    )
    one = F.lit(1).cast("long")
    s_m, s_h = (F.greatest(F.coalesce(F.col(c), one), one) for c in ("s_m", "s_h"))
    dealt = F.xxhash64("message_id")
    cells = (
        m.join(sizes, "user_id", "left").withColumn("cell_m", F.pmod(dealt, s_m))
        .withColumn("cell_h", F.explode(F.sequence(F.lit(0).cast("long"), s_h - 1)))
    ).unionByName(
        h.join(sizes, "user_id", "left").withColumn("cell_h", F.pmod(dealt, s_h))
        .withColumn("cell_m", F.explode(F.sequence(F.lit(0).cast("long"), s_m - 1)))
    ).drop("s_m", "s_h")
    # Recipients are many and mostly small, so a call into Python takes a batch of whole cells.
    ranked = spread(cells, *_CELL_KEYS).sortWithinPartitions(*_CELL_KEYS).mapInArrow(
        _cell_ranker(k_evidence, k_near, C.EVIDENCE_MIN_SCORE, C.NEAR_DUPLICATE_MIN_JACCARD), _CELL_SCHEMA
    )
    # Most messages have one cell, whose lists are the result. The entries of the others meet in one sorted stream per
    # message, of which the first k go on: no list is longer than k, however many cells a recipient has.
    alone = F.count("*").over(Window.partitionBy("message_id")) == 1
    kinds = {"evidence": k_evidence, "near_duplicates": k_near}
    no_entry = F.lit(None).cast(ranked.schema["evidence"].dataType.elementType)

    def item(kind: str, entry: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), entry.alias("entry"))

    def items(kind: str) -> Column:
        # A message without winners has no list.
        return F.transform(F.coalesce(kind, F.array().cast(ranked.schema[kind].dataType)), lambda e: item(kind, e))

    summary = F.array(item("summary", no_entry))
    parts = ranked.withColumn("_alone", alone).withColumn(
        "_item", F.explode(F.when(F.col("_alone"), summary).otherwise(F.concat(summary, *[items(k) for k in kinds]))))
    # Natural struct order is the ranking: value descending, newest first, smallest id.
    entry, kind = F.col("_item.entry"), F.col("_item.kind")
    in_kind = Window.partitionBy("message_id", "_item.kind").orderBy(entry["_by_value"], entry["_by_time"], entry["history_message_id"])
    wanted = reduce(lambda chosen, k: chosen.when(kind == k, kinds[k]), kinds, F.when(F.lit(False), 0))
    merging = parts.withColumn("_place", F.row_number().over(in_kind)).filter((kind == "summary") | (F.col("_place") <= wanted))

    def top(name: str) -> Column:
        lists = F.when(F.col("_alone"), F.col(name)).when(kind == name, F.array(entry))
        return F.sort_array(F.flatten(F.collect_list(lists)))

    figures = kind == "summary"
    merged = merging.groupBy("message_id").agg(
        F.max(F.when(figures, F.col("max_jaccard"))).alias("max_jaccard"), F.sum(F.when(figures, F.col("n_duplicates"))).alias("duplicate_count"),
        *[top(k).alias(k) for k in kinds],
    )
    out = messages.select("message_id").join(merged, "message_id", "left")
    empty = F.array().cast(out.schema["evidence"].dataType)
    return out.withColumns({
        "duplicate_count": F.coalesce("duplicate_count", F.lit(0)),
        "evidence": F.coalesce("evidence", empty), "near_duplicates": F.coalesce("near_duplicates", empty),
    })


def evidence_rows(ranked: DataFrame, column: str = "evidence") -> DataFrame:
    """Long form: one row per message and ranked history row."""
    return ranked.select("message_id", F.posexplode(column).alias("position", "e")).select(
        "message_id", (F.col("position") + 1).alias("rank"), "e.*"
    ).drop("_by_value", "_by_time")
