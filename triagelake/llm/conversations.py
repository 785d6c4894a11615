"""Conversation structure repair by a checkpointed dynamic program.

A conversation is right if its roles read ``(s?(ua)+)?`` by their initials. Edits keep a turn, give it
the other role, delete it or insert an empty one; the cheapest ones are found backward, as a vector of
four costs, one for each state the reading can be in. Vectors are kept only at checkpoints, a square
root of the turns apart. Walking forward, the turns between two checkpoints are worked out again and
the smallest edit in ASCII order that keeps to the cheapest cost is emitted.

Turns are sorted by range, so a long conversation lies in several partitions. It is cut into blocks of
bounded size. A block's turns act on cost vectors as a matrix of least sums, so the vectors between the
blocks come from the matrices alone, and the blocks are then walked apart from each other, from each
state in which they may begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from triagelake.llm.common import SPACE, saved, slices

#: Turns of one block of a long conversation; shorter conversations are one block.
BLOCK_TURNS = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a turn as kept in a block: none, cut short, no text, said before.
SOUND, CUT, BLANK, DUPLICATE = range(4)
#: States: nothing read, a system turn, a user turn, an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: What the state becomes by each initial (s, u, a, other), -1 where it must not come.
_READ = ((_SYSTEM, _USER, -1, -1), (-1, _USER, -1, -1), (-1, -1, _ASSISTANT, -1), (-1, _USER, -1, -1))
#: The state after the one role that may speak next.
_SPEAK = (_USER, _USER, _ASSISTANT, _USER)
_NEVER = 1 << 60
_INITIALS = "sua"
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
Vector = tuple[int, int, int, int]


def _closed(start: int, system: int, user: int, assistant: int) -> Vector:
    """The vector if turns may be inserted first."""
    owing, done = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + owing), min(system, INSERT + owing), owing, done


#: Costs after the last turn: a started exchange has to be completed.
END = _closed(0, _NEVER, _NEVER, 0)


def before(code: int, after: Vector) -> Vector:
    """Costs before a turn (initial + 4 * fault) from those after it."""
    initial, fault = code & 3, code >> 2
    costs = [DELETE + c for c in after]
    if fault <= CUT:
        extra = TRUNCATED * fault
        for state in range(4):
            read = _READ[state][initial]
            if read >= 0:
                costs[state] = min(costs[state], KEEP + extra + after[read])
            costs[state] = min(costs[state], REROLE + extra + after[_SPEAK[state]])
    return _closed(*costs)


def cheapest(codes: bytes, end: Vector = END) -> Vector:
    """Costs before the first of the turns."""
    for code in reversed(codes):
        end = before(code, end)
    return end


def walk(codes: bytes, state: int = _START, end: Vector = END, last: bool = True) -> tuple[str, int]:
    """The cheapest edits' initials in order, the smallest in ASCII order, and the state after them.

    ``end`` has the costs after these turns; ``last`` also completes an exchange there.
    """
    step = isqrt(len(codes)) + 1
    marks = {}
    vector = end
    for at in range(len(codes) - 1, -1, -1):
        if (at + 1) % step == 0 or at + 1 == len(codes):
            marks[at // step] = vector
        vector = before(codes[at], vector)
    out = []
    for block in range(-(-len(codes) // step)):
        part = codes[block * step:(block + 1) * step]
        vectors = [marks[block]]
        for code in reversed(part):
            vectors.append(before(code, vectors[-1]))
        for k, code in enumerate(part):
            now, after = vectors[len(part) - k], vectors[len(part) - k - 1]
            initial, fault = code & 3, code >> 2
            extra = TRUNCATED * fault
            while True:
                if now[state] == DELETE + after[state]:
                    out.append("D")
                elif now[state] == INSERT + now[_SPEAK[state]]:
                    out.append("I")
                    state = _SPEAK[state]
                    continue
                elif _READ[state][initial] >= 0 and fault <= CUT and now[state] == KEEP + extra + after[_READ[state][initial]]:
                    out.append("K")
                    state = _READ[state][initial]
                else:
                    out.append("R")
                    state = _SPEAK[state]
                break
    while last and end[state]:
        out.append("I")
        state = _SPEAK[state]
    return "".join(out), state


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before the turns to each state after them, row by row."""
    columns = [cheapest(codes, tuple(0 if s == t else _NEVER for s in range(4))) for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(costs: list[int], end: Vector) -> Vector:
    return tuple(min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4))


def illegal_pairs(codes: bytes) -> int:
    """Neighbours other than system-user, user-assistant and assistant-user."""
    return sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``turns`` with planted faults; nulls of role and text become a space.

    By the crc32 of "conv_id:turn" modulo 20 (nulls as a space): 0 drops a turn, 1 empties its text, 2
    removes the marks . ! ? from it, 3 repeats it, 4 makes its role "user".
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return turns.where(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def conversation_key(conv: Column) -> Column:
    """A string that no two conversation ids share; null ids are one conversation."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


@dataclass
class Repair:
    """``turns``: (key, at, role, text, block, ...) in order; ``audits``: (key, block, state, audit) of every block;
    ``summary``: a row per conversation."""

    turns: DataFrame
    audits: DataFrame
    summary: DataFrame


def ordered(turns: DataFrame) -> DataFrame:
    """(key, turn, role, text, at): turns sorted over the whole table; ``at`` is a turn's place.

    Turns of equal number are in order of role and text. Equal ones may be in any order and can spread.
    """
    rows = turns.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        F.monotonically_increasing_id().alias("given"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("given")]
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("given")
                 .withColumn("at", F.monotonically_increasing_id()))


def _faults(rows: DataFrame) -> DataFrame:
    """(key, turn, at, initial, fault) of every turn."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    marked = rows.select(
        "key", "turn", "at", said.alias("said"),
        F.coalesce(F.array_position(F.array(*map(F.lit, _INITIALS)), F.substring("role", 1, 1)), F.lit(0)).alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    repeated = marked.groupBy("key", "said").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    return marked.join(repeated, ["key", "said"], "left").select(
        "key", "turn", "at", F.when(F.col("initial") > 0, F.col("initial") - 1).otherwise(3).cast("int").alias("initial"), fault.alias("fault"))


def repair(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> Repair:
    """The cheapest repair of every conversation of (conv_id, turn, role, text).

    A turn's first fault counts: blank (no text but white space), duplicate (role and text came before in
    the conversation), truncated (the last character is not . ! or ?). Keeping costs 0, the role user or
    assistant instead 1, deleting 2 and must be done for blank and duplicate turns, inserting an empty
    turn 5; a truncated turn that stays adds 5. ``audit`` has the initials of the edits.

    Null roles and texts count as one space, null turns come first, null ids are one conversation.
    Repeated turns are duplicates. Texts are read whole. Other columns are not read. Without turns there
    are no rows.
    """
    rows = ordered(turns)
    faults = saved(_faults(rows))
    counts = saved(faults.groupBy("key").agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.col("fault") == code, 1)).alias(name) for name, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")))
    long_ones = saved(counts.where(F.col("n") > block_turns).select("key", F.lit(True).alias("long")))
    place = F.when(F.col("long"), F.col("at") - F.col("at") % block_turns).otherwise(F.lit(-1)).cast("long")
    blocks = saved(
        faults.join(long_ones, "key", "left").withColumn("block", place).groupBy("key", "block")
        .agg(F.array_sort(F.collect_list(F.struct("at", (F.col("initial") + 4 * F.col("fault")).alias("code")))).alias("codes"))
        .select("key", "block", F.col("codes.code").alias("codes")))
    whole = saved(blocks.where("block < 0").select("key", "codes").mapInArrow(_solve, "key string, cost long, illegal long, audit string"))
    parts = saved(blocks.where("block >= 0").mapInArrow(_matrices, "key string, block long, matrix array<long>, first int, last int, illegal long"))
    chained = saved(parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "matrix", "first", "last", "illegal"))).alias("parts"))
                    .mapInArrow(_chain, "key string, block long, end array<long>, last boolean, cost long, illegal long"))
    walks = saved(blocks.join(chained, ["key", "block"]).select("key", "block", "codes", "end", "last")
                  .mapInArrow(_walks, "key string, block long, state int, audit string, after int"))
    starts = saved(walks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "state", "after"))).alias("walks"))
                   .mapInArrow(_starts, "key string, block long, state int"))
    audits = saved(walks.join(starts, ["key", "block", "state"]).select("key", "block", "state", "audit").unionByName(
        whole.select("key", F.lit(-1).cast("long").alias("block"), F.lit(_START).alias("state"), "audit")))
    costs = whole.select("key", "cost", "illegal").unionByName(
        chained.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal")))
    joined = audits.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    summary = counts.join(costs, "key").join(joined, "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(rows.join(long_ones, "key", "left").withColumn("block", place).drop("long"), audits, summary)


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, codes in slices(batches):
        own = [bytes(c) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([cheapest(c)[_START] for c in own], pa.int64()), pa.array([illegal_pairs(c) for c in own], pa.int64()),
             pa.array([walk(c)[0] for c in own], pa.string())], ["key", "cost", "illegal", "audit"])


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, blocks, codes in slices(batches):
        own = [bytes(c) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(map(matrix, own), pa.list_(pa.int64())), pa.array([c[0] for c in own], pa.int32()),
             pa.array([c[-1] for c in own], pa.int32()), pa.array([illegal_pairs(c) for c in own], pa.int64())], ["key", "block", "matrix", "first", "last", "illegal"])


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs after each block; the first block has the cost of all, every block its illegal neighbours."""
    for keys, lists in slices(batches, 16):
        for key, parts in zip(keys, lists):
            ends, vector = [], END
            for part in reversed(parts):
                ends.append(vector)
                vector = through(part["matrix"], vector)
            ends.reverse()
            seams = [illegal_pairs(bytes([a["last"], b["first"]])) for a, b in zip(parts, parts[1:])] + [0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(parts), pa.string()), pa.array([p["block"] for p in parts], pa.int64()), pa.array(map(list, ends), pa.list_(pa.int64())),
                 pa.array([k == len(parts) - 1 for k in range(len(parts))], pa.bool_()), pa.array([vector[_START]] + [0] * (len(parts) - 1), pa.int64()),
                 pa.array([p["illegal"] + seam for p, seam in zip(parts, seams)], pa.int64())], ["key", "block", "end", "last", "cost", "illegal"])


def _walks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, blocks, codes, ends, lasts in slices(batches, 16):
        rows = [(key, block, state, *walk(bytes(own), state, tuple(end), last))
                for key, block, own, end, last in zip(keys, blocks, codes, ends, lasts) for state in range(4)]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()))],
                                         ["key", "block", "state", "audit", "after"])


def _starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block begins."""
    for keys, lists in slices(batches, 16):
        rows = []
        for key, walks in zip(keys, lists):
            state = _START
            for at in range(0, len(walks), 4):  # a walk from each of the four states, in their order
                rows.append((key, walks[at]["block"], state))
                state = walks[at + state]["after"]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()))], ["key", "block", "state"])


def repaired_turns(found: Repair, by: tuple[str, ...] = ("key", "block")) -> DataFrame:
    """(key, block, place, role, text): the turns after repair, in order within each task.

    Each block's audit comes before its turns, so the edits are applied as the rows stream by. ``by``
    says what stays together: blocks, or with ``("key",)`` whole conversations.
    """
    none = F.lit(None)
    rows = found.turns.select("key", "block", "at", "role", "text", none.cast("int").alias("state"), none.cast("string").alias("audit")).unionByName(
        found.audits.select("key", "block", F.lit(-1).cast("long").alias("at"), none.cast("string").alias("role"), none.cast("string").alias("text"), "state", "audit"))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, step, state, here, place = "", 0, _START, ("", 0), 0
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal step, state, place
            while step < len(audit) and audit[step] == "I":
                state = _SPEAK[state]
                out.append((*here, place, _ROLE[state], ""))
                step, place = step + 1, place + 1

        for columns in slices(batches):
            for key, block, at, role, text, began, edits in zip(*columns):
                if at < 0:
                    inserts()
                    audit, step, state, here, place = edits, 0, began, (key, block), 0
                    continue
                inserts()
                edit, step = audit[step], step + 1
                if edit != "D":
                    if edit == "R":
                        state = _SPEAK[state]
                        role = _ROLE[state]
                    else:
                        state = _READ[state][_INITIALS.index(role[0])]
                    out.append((*here, place, role, text))
                    place += 1
            yield _turn_rows(out)
            out = []
        inserts()
        yield _turn_rows(out)

    spread = rows.repartition(*by).sortWithinPartitions("key", "block", "at")
    return spread.mapInArrow(apply, "key string, block long, place long, role string, text string")


def _turn_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "block", "place", "role", "text"])


def digests(found: Repair) -> DataFrame:
    """(key, repaired_sha256): the hash of ``role:text`` of the repaired turns, joined by line ends.

    A hash is made in one sweep, so a conversation is read by one task, but its turns only stream by.
    """
    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for keys, roles, texts in slices(batches):
            for own, role, text in zip(keys, roles, texts):
                if own != key:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _digest_rows(out)
            out = []
        yield _digest_rows([(key, state.hexdigest())] if state else [])

    return repaired_turns(found, ("key",)).select("key", "role", "text").mapInArrow(sweep, "key string, repaired_sha256 string")


def _digest_rows(out: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "repaired_sha256"])


def report(turns: DataFrame, damaged: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each conv_id of ``turns``: what was found and done in its turns of ``damaged``."""
    found = repair(damaged, block_turns)
    every = turns.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found.summary, "key", "left").join(digests(found), "key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
