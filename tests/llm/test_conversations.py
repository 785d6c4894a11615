"""Conversation repair against every possible edit, in blocks and whole."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest

from triagelake.llm import conversations as c

RIGHT, BEGUN = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")
WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, key string, at int, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 5, "b") for r in rows], SCHEMA)


def every_edit(rows):
    """(cost, audit, repaired) of all edits with two insertions at most between turns."""
    def go(i, cost, audit, out, inserts):
        if not BEGUN.fullmatch("".join(r[0][:1] or "?" for r in out)):
            return
        if i == len(rows) and RIGHT.fullmatch("".join(r[0][:1] or "?" for r in out)):
            yield cost, audit, tuple(out)
        if inserts < 2:
            for role in ("user", "assistant"):
                yield from go(i, cost + 5, audit + "I", out + [(role, "")], inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            yield from go(i + 1, cost + 2, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                yield from go(i + 1, cost + extra, audit + "K", out + [(role, text)], 0)
                for other in ("user", "assistant"):
                    yield from go(i + 1, cost + 1 + extra, audit + "R", out + [(other, text)], 0)
    return min(go(0, 0, "", [], 0))


def expected(original, rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in {r[0] for r in original}:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told = set(), []
        for _, role, text in own:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, repaired = every_edit(told)
        faults = [f for _, _, f in told]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def cases():
    noise, rows = random.Random(8), []
    for conv in range(60):
        for turn in range(noise.randint(1, 4)):
            role = noise.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "aide", "user\nx"])
            text = noise.choice(["One.", "Two!", "Three", "", " \t", None, "Four? ", "é…", "Same.", "Same.", "a.\n"])
            rows.append((conv, noise.choice([turn, turn, turn + 1, None]), role, text))
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (99, 3, "user", "Only"), (98, None, None, None), (97, 1, "user", "x." * 50_000), (97, 2, "assistant", "ok.")]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_repair_against_every_edit(spark, block):
    rows = cases()
    found = c.report(table(spark, rows), table(spark, rows), block_turns=block)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows, rows)


def test_repaired_turns_are_right(spark):
    rows = cases()
    found = c.repair(table(spark, rows), block_turns=2)
    by = defaultdict(list)
    for r in c.repaired_turns(found).collect():
        by[r.key].append((r.block, r.place, r.role))
    for own in by.values():
        assert RIGHT.fullmatch("".join(role[0] for _, _, role in sorted(own)))


def test_damage_by_hash(spark):
    rows = cases()
    wanted = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        if kind:
            new = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
            wanted += [(conv, turn, "user" if kind == 4 else shown[2], new)] * (2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, c.damage(table(spark, rows)).collect()))) == sorted(map(repr, wanted))


def test_walks_in_blocks_are_the_whole_walk():
    noise = random.Random(4)
    for _ in range(300):
        codes = bytes(noise.choice([0, 1, 2, 3]) + 4 * noise.choice([0, 0, 0, 1, 2, 3]) for _ in range(noise.randint(0, 40)))
        audit, state = c.walk(codes)
        assert state in (0, 3)
        cut = noise.randint(0, len(codes))
        left, right = codes[:cut], codes[cut:]
        between = c.through(c.matrix(right), c.END)
        assert between == c.cheapest(right) and c.through(c.matrix(left), between) == c.cheapest(codes)
        if left and right:
            first, state = c.walk(left, 0, between, last=False)
            assert first + c.walk(right, state)[0] == audit


def test_one_long_conversation(spark):
    noise = random.Random(2)
    rows = [(1, k, noise.choice(["user", "assistant", "assistant"]), f"Turn {k}.") for k in range(30_000)]
    start = time.time()
    whole = c.report(table(spark, rows), table(spark, rows), block_turns=1_000_000).collect()
    parts = c.report(table(spark, rows), table(spark, rows), block_turns=300).collect()
    assert whole == parts and whole[0].cost == c.cheapest(bytes({"u": 1, "a": 2}[r[2][0]] for r in rows))[0]
    assert time.time() - start < 120


def test_no_turns(spark):
    rows = [(1, 1, "user", "Hi.")]
    nothing = c.report(table(spark, rows), table(spark, []))
    assert [tuple(r) for r in nothing.collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.report(table(spark, []), table(spark, [])).collect() == []
