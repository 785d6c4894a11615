"""Vector bin packing: round trips, limits and padding; token ids against the tokenizers."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from triagelake.llm import vectorpack
from triagelake.llm.tokens import encoder
from triagelake.llm.vectorpack import Example, Limits, Pool

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, "Don't it's 12½ x²  y\n\n z"), (4, "İstanbul ﬁne ǅ 中文 é"), (5, "a <|endoftext|> b"), (6, "tab\x0bfeed\x1fsep\x85"),
       (7, "word " * 9000), (None, "no id"), (8, "same"), (8, "same"), (9, " " * 5000 + "end"), (10, "x" * 60_000)]


def reference(text):
    from tokenizers import Tokenizer

    if not hasattr(reference, "own"):
        reference.own = Tokenizer.from_file(PATH)
    return np.array(reference.own.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def table(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x", "q") for d, t in rows], "doc_id long, text string, length int, ids string, before string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own, whole = encoder(path), Tokenizer.from_file(path)
    every, noise = "".join(chr(c) for c in range(1, 0x250)), random.Random(5)
    texts = [t or "" for _, t in ODD] + [every, every[::-1], " ".join(every), " " * 1_000_000 + "a", "\n" * 3000]
    texts += ["".join(noise.choice("ab'Z 9½ß.,-é\n\t's<|") for _ in range(80)) for _ in range(400)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert own(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check(found, rows, limits):
    by_doc, seats = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length * 4 == len(r.ids) and r.length > 0
        by_doc[r.doc_id].append(r)
        seats[r.sequence_id].append(r)
    for d, own in by_doc.items():
        # Copies of a document are cut each in its own way, so their ids are compared by place.
        wanted = Counter()
        for text in (t for x, t in rows if x == d):
            ids = np.frombuffer(reference(text), "<u4")
            wanted.update((len(ids), at, int(v)) for at, v in enumerate(ids))
        assert Counter((r.doc_tokens, r.start + k, int(v)) for r in own for k, v in enumerate(np.frombuffer(bytes(r.ids), "<u4"))) == wanted
    for own in seats.values():
        own.sort(key=lambda r: r.offset)
        length = sum(r.length for r in own)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and [r.segment for r in own] == list(range(len(own)))
        assert len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss and length <= limits.tokens
        assert length == limits.tokens or length & (length - 1) == 0
    return seats


@pytest.mark.parametrize("limits,pool", [(Limits(), 8192), (Limits(2048, 3, 2048), 16), (Limits(512, 64, 100), 50)])
def test_pack_round_trip(spark, limits, pool):
    rows = ODD + [(100 + k, "one two three " * (k % 90 * 8)) for k in range(200)]
    found = vectorpack.pack(table(spark, rows).repartition(3), PATH, limits, pool=pool, keep_ids=True).collect()
    seats = check(found, rows, limits)
    if limits == Limits():
        total = sum(r.length for r in found)
        # A few short sequences of powers of two for each task at most.
        assert total / 2048 <= len(seats) <= total / 2048 + 3 * 12


def test_prompts_bear_no_loss(spark):
    rows = [(k, "tell me more about this " * (k % 7 * 9), "an answer of some words " * (k % 5 * 7)) for k in range(120)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, prompt string, text string, loss_tokens string")
    limits = Limits(256, 5, 128)
    found = vectorpack.pack(docs, PATH, limits, prompt=F.col("prompt"), keep_ids=True).collect()
    loss, ids = Counter(), defaultdict(list)
    for r in found:
        loss[r.doc_id] += r.loss_tokens
        ids[r.doc_id].append((r.start, bytes(r.ids)))
    for k, prompt, text in rows:
        assert b"".join(x for _, x in sorted(ids[k])) == reference(prompt)[:-4] + reference(text)
        assert loss[k] == len(reference(text)) // 4
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append(r)
    for own in by.values():
        assert len(own) <= 5 and sum(r.loss_tokens for r in own) <= 128
        n = sum(r.length for r in own)
        assert n <= 256 and (n == 256 or n & (n - 1) == 0)


def test_pools_of_random_vectors():
    noise = random.Random(3)
    for _ in range(60):
        limits = Limits(noise.choice([4, 32, 100]), noise.choice([1, 2, 9]), noise.choice([1, 10, 100]))
        pool, total = Pool(limits), 0
        for k in range(noise.randint(1, 80)):
            n = noise.randint(1, limits.tokens)
            e = Example(k, 0, bytes(4 * n), noise.randint(0, n), n)
            for part in vectorpack._stretches(e, limits):
                pool.add(part)
            total += n
        while pool.size:
            own = pool.sequence()
            n = sum(e.length for e in own)
            assert own and n <= limits.tokens and len(own) <= limits.segments and sum(e.loss() for e in own) <= limits.loss
            assert n == limits.tokens or n & (n - 1) == 0
            total -= n
        assert not total


def test_dot_product_prefers_what_is_scarce_least():
    # Much room in tokens and little in segments: the longest example goes first, the exact one closes.
    pool = Pool(Limits(100, 3, 100))
    for n in (60, 30, 10, 5, 40):
        pool.add(Example(n, 0, bytes(4 * n), n, n))
    assert [e.length for e in pool.sequence()] == [60, 40]


def test_empty_table(spark):
    found = vectorpack.pack(table(spark, []), PATH)
    assert found.collect() == [] and found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "segment", "sequence_id", "offset"]
