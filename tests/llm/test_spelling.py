"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from triagelake.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def groups(counts, ratio=5):
    out = {}
    for word, n in counts.items():
        near = sorted((-m, other) for other, m in counts.items() if one_edit(word, other))
        formed = near and -near[0][0] >= ratio * n
        out[word] = (near[0][1] if formed else None, n, len(near), -near[0][0] if formed else None)
    rows = []
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((word, form, root, n, near, form_n))
    return sorted(rows)


def vocabulary():
    noise, counts = random.Random(6), {}
    for _ in range(400):
        counts["".join(noise.choice("abzéÉ÷ÿ") for _ in range(noise.randint(1, 6)))] = noise.choice([1, 2, 9, 50, 300, 2000])
    counts |= {"a" * 3000: 7, "a" * 3001: 90, "a" * 2999 + "b": 7, "aaaa": 5, "aaaaa": 25, "aaaaaa": 125}
    # A chain of forms, each five times as frequent as the one before.
    return counts | {f"chain{'x' * k}": 5 ** k for k in range(1, 12)}


@pytest.mark.parametrize("blocks", [64, 2_000_000])
def test_groups_against_all_pairs(spark, blocks):
    counts = vocabulary()
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 4, "x"), ("null", None, "x")]
    found = spelling.group_variants(spark.createDataFrame(rows, "word string, n long, near string"), pass_blocks=blocks)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == groups(counts)


def test_other_letters_and_repeats(spark):
    rows = [("wordone", 2), ("wordone", 3), ("wordtwo", 1), ("w4rdone", 9), ("слово", 9), ("wordonе", 50), ("wordon", 25)]
    found = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found["wordone"].n == 5 and found["wordone"].form == "wordon" and found["wordone"].n_near == 1
    assert found["слово"].n_near == found["w4rdone"].n_near == found["wordonе"].n_near == 0 and len(found) == 6


def counted(rows, every):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= 6
    return {w: n for w, n in counts.items() if n}


@pytest.mark.parametrize("every", [0, 3])
def test_words_of_texts(spark, every):
    noise = random.Random(1)
    letters = "abcÉéß×÷ÿĀ中😀 .-'Z0_\n"
    rows = [(k, "".join(noise.choice(letters + "abcdef" * 4) for _ in range(400))) for k in range(60)]
    rows += [(1, None), (2, ""), (None, "Nothing without words"), (3, "repeat Repeat REPEAT"), (3, "repeat Repeat REPEAT"), (4, "long" * 40_000), (5, "word " * 50_000 + "stretches " * 9)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.word_counts(docs, damage_every=every).collect()} == counted(rows, every)
    few = {w: n for w, n in counted(rows, every).items() if n >= 5}
    assert sorted(map(tuple, spelling.variants(docs, damage_every=every).collect())) == groups(few)


def test_filter_knows_its_words_and_few_others():
    noise = np.random.default_rng(2)
    words = [bytes(noise.integers(97, 123, 9).astype(np.uint8)).decode() for _ in range(20_000)]
    shards = spelling.Shards({8: 100, 9: len(set(words))})
    dense = np.zeros(shards.total, np.uint64)
    hashes = {}
    for _, which, letters in spelling._by_length(words):
        own = spelling._letters(np.arange(9), letters).sum(axis=1, dtype=np.uint64)
        block, bits = shards.places(9, own)
        np.bitwise_or.at(dense, block, spelling._set_bits(bits))
        hashes |= dict(zip(which, own))
    filter_ = spelling.Filter(shards, 0, dense)
    assert len(filter_.known(9, np.array(list(hashes.values())))) == len(words)
    assert len(filter_.known(9, noise.integers(0, 1 << 63, 100_000).astype(np.uint64))) < 1000


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
