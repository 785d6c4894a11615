"""Line dedup, packing, sentence spans, near duplicates and decontamination against brute force."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from triagelake.llm import decontam, lines, neardup, packing, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, line int, drop string, component string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "é" * 12 + "\n" + "é" * 12), (6, "É" * 12), (7, "\n\n"), (None, "a line without an id here"), (8, "x\x00y ퟿ 😀")]


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, 7, "x", "y") for d, t in rows], SCHEMA)


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# Line dedup


def line_cases():
    long = "A Shared Licence line"
    return ODD + [(10, f"{long}\nown ten ten"), (11, f"first one here\n  {long.upper()}\t"), (12, f"{long.lower()}\n{long}\n{long}"),
                  (12, f"{long.lower()}\n{long}\n{long}"), (13, "short\nshort"), (14, "short"), (20, "\n".join(f"line number {k}" for k in range(3000))),
                  (21, "line number 2999"), (22, "a line without an id here")]


@pytest.mark.parametrize("limit,sent", [(0, 0), (1000, 0), (0, lines.SENT_BITS)])
def test_lines_against_brute_force(spark, limit, sent):
    rows = line_cases()
    holders = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders[key(line)].add(d)
    expected = []
    for d, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if d is None or len(holders[key(x)]) < 2 or d == min(holders[key(x)])]
        expected.append((d, None if t is None else "\n".join(left), len(own), len(own) - len(left)))
    got = lines.dedup_lines(table(spark, rows).repartition(3), broadcast_rows=limit, sent_bits=sent)
    assert got.columns == ["doc_id", "text", "line", "drop", "component", "n_lines", "n_dropped"]
    assert sorted(map(repr, [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()])) == sorted(map(repr, expected))


def test_filters_pass_every_repeat():
    random_ = np.random.default_rng(3)
    seen = random_.integers(0, 1 << 63, 300_000).astype(np.uint64)
    filter_ = lines._Filter(1 << 10)
    for at in range(0, len(seen), 5000):
        filter_.add(seen[at:at + 5000])
    assert filter_.has(seen).all()
    assert filter_.has(random_.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.05


def test_second_filter_knows_every_repeat_and_few_others(spark):
    rows = [(k, "\n".join(f"line of group {k // 2 * 50 + i}" if i < 20 else f"own line {k} {i}" for i in range(40))) for k in range(2000)]
    docs = table(spark, rows).repartition(7)
    bits = lines.filter_bits(docs)
    packed = lines.twice_seen(docs, bits)
    key = lambda text: np.array([xxhash.xxh3_64_intdigest(text.encode())], np.uint64)
    assert all(lines._known_twice(packed, key(f"line of group {k // 2 * 50 + i}"))[0] for k in range(0, 2000, 2) for i in range(20))
    alone = sum(lines._known_twice(packed, key(f"own line {k} {i}"))[0] for k in range(500) for i in range(20, 40))
    assert alone < 300
    suspects = lines.suspected_lines(docs).count()
    assert 40_000 <= suspects < 42_000


def test_long_documents_take_time_in_proportion(spark):
    text = "\n".join(f"a line of some length {k}" for k in range(200_000))
    start = time.time()
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, [(1, text), (2, text), (3, text + "\nand one more line")])).collect()}
    assert got[1].text == text and got[2].text == "" and got[3].text == "and one more line" and got[2].n_dropped == 200_000
    assert time.time() - start < 60


def test_no_repeat_is_lost_in_a_crowded_partition():
    hashes = np.random.default_rng(1).integers(-1 << 63, 1 << 63, 300_000, endpoint=False)
    twice = [pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool))], ["h", "many"])
             for part in np.split(hashes, 30)] * 2
    out = np.concatenate([b.column(0).to_numpy() for b in lines._second_sightings(twice)])
    assert set(hashes.tolist()) <= set(out.tolist())


# Packing


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PACKED = [(1, None), (2, ""), (3, "Don't it's 12½ x²  y z"), (4, "İstanbul ﬁne ǅ 中文 é"), (5, "a <|endoftext|> b"), (6, "tab\x0bfeed\x1fsep"),
          (7, "word " * 9000), (None, "no id"), (8, "same"), (8, "same"), (9, "ÀÉ Straße ¿qué? '' 's'd"), (10, "\U0001d7d9 ٣ Ⅷ")]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path())
    every = "".join(chr(c) for c in range(1, 0x250))
    noise = random.Random(5)
    texts = [t for _, t in PACKED] + [every, every[::-1], " ".join(every)] + [
        "".join(noise.choice("ab'Z 9½ß.,-é\n\t's") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert packing.text_ids(text, path()) == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()


def test_pack_round_trip(spark):
    rows = PACKED + [(100 + k, "one two three " * (k % 90 * 8)) for k in range(300)]
    packed = packing.pack(table(spark, rows), path(), keep_ids=True)
    found = packed.collect()
    texts = Counter((d, packing.text_ids(t, path())) for d, t in rows)
    by_doc = defaultdict(list)
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length * 4 == len(r.ids) and 0 < r.length <= 2048
        by_doc[r.doc_id].append(r)
    for d, own in by_doc.items():
        whole = Counter()
        own.sort(key=lambda r: r.piece)
        for copy in range(sum(n for (x, _), n in texts.items() if x == d)):
            whole[b"".join(bytes(r.ids) for r in own[copy::sum(r.piece == 0 for r in own)])] += 1
        assert whole == Counter({ids: n for (x, ids), n in texts.items() if x == d})
    seats = defaultdict(list)
    for r in found:
        seats[r.sequence_id].append((r.offset, r.length))
    for own in seats.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in found)
    assert len(seats) <= -(-total // 2048) + 1
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert sum(whole.values()) == total


def test_plan_uses_every_piece_once():
    noise = random.Random(1)
    for _ in range(30):
        size = noise.choice([8, 50, 2048])
        counts = Counter(noise.randint(1, size) for _ in range(noise.randint(0, 500)))
        plan, used = packing.plan_bins(counts, size), Counter()
        for times, need in plan:
            assert times > 0 and sum(k * n for k, n in need.items()) <= size
            for length, n in need.items():
                used[length] += times * n
        assert used == counts


def test_sum_index_gives_available_combinations():
    noise = random.Random(9)
    for _ in range(200):
        size = noise.choice([9, 40, 100])
        counts = Counter(noise.randint(1, size) for _ in range(noise.randint(1, 25)))
        index = packing.SumIndex(counts, size)
        for total in range(1, size):
            found = index.complement(total, [])
            if found:
                assert sum(found) == total and not Counter(found) - counts
            else:
                pieces = sorted(counts.elements())
                sums = {0}
                for many in range(1, 4):
                    sums |= {sum(c) for c in combinations(pieces, many)} if len(pieces) < 26 else set()
                assert total not in sums


def test_exact_complements_are_found():
    assert packing.plan_bins({60: 3, 40: 3}, 100) == [(3, {60: 1, 40: 1})]
    assert packing.plan_bins({50: 4, 30: 4, 20: 4}, 100)[0] == (2, {50: 2})
    assert packing.plan_bins({70: 2, 20: 2, 10: 2}, 100) == [(2, {70: 1, 20: 1, 10: 1})]
    assert packing.plan_bins({61: 1, 20: 1, 10: 1, 9: 1}, 100) == [(1, {61: 1, 20: 1, 10: 1, 9: 1})]


# Sentence spans


def passage(noise, words):
    return " ".join("".join(noise.choice("abcdefgh") for _ in range(6)) + ("." if k % 7 == 6 else "") for k in range(words))


def test_spans_cut_all_but_the_first(spark):
    noise = random.Random(2)
    shared, other = passage(noise, 63), passage(noise, 70)
    rows = ODD + [(30, f"Start one. {shared} End one."), (31, f"{passage(noise, 20)}. {shared} Then another end."), (32, passage(noise, 200)),
                  (33, f"{other}\n{passage(noise, 40)}.\n{other}"), (34, "Licensed under the Apache License, Version 2.0."),
                  (35, "Licensed under the Apache License, Version 2.0.")]
    out = {r.doc_id: r for r in spans.dedup_spans(table(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert {d for d, r in out.items() if r.n_cut} == {31, 33}
    assert out[30].text == dict(rows)[30] and shared[80:200] not in out[31].text and "Then another end." in out[31].text
    assert out[33].text.count(other[60:200]) == 1 and out[33].text.startswith(other[:50])
    found = {r.doc: r for r in spans.covered(table(spark, rows)).collect()}
    assert list(found[31].first_docs) == [30] and list(found[33].first_docs) == [33]


def test_runs_match_brute_force(spark):
    noise = random.Random(4)
    bank = [passage(noise, noise.choice([3, 9, 15, 30])).rstrip(".") + "." for _ in range(12)]
    rows = [(k, " ".join(noise.choice(bank) for _ in range(noise.randint(1, 9)))) for k in range(60)]
    places = defaultdict(list)
    for d, t in rows:
        for start, end, own in spans.runs(t):
            places[own].append((d, start, end))
    expected = {p for own in places.values() for p in sorted(own)[1:]}
    assert {(r.doc, r.start, r.end) for r in spans.repeated_runs(table(spark, rows)).collect()} == expected


def test_shortest_runs_cover_what_all_runs_cover(spark):
    noise = random.Random(6)
    bank = [" ".join(f"w{k}x{i}" for i in range(n)) + "." for k, n in enumerate([25, 10, 8, 19, 1, 12, 20, 5, 3])]
    rows = [(1, " ".join(bank[:3])), (2, f"Its own first words. {bank[0]} {bank[1]} {bank[2]} Its own last words.")]
    rows += [(k, " ".join(noise.choice(bank) for _ in range(noise.randint(1, 9)))) for k in range(10, 60)]
    places = defaultdict(list)
    for d, t in rows:
        found = spans.sentences(t)
        for a in range(len(found)):
            for b in range(a, len(found)):
                if sum(n for _, _, n, _ in found[a:b + 1]) >= spans.MIN_WORDS:
                    places[b"".join(h for _, _, _, h in found[a:b + 1])].append((d, found[a][0], found[b][1]))
    expected = defaultdict(set)
    for own in places.values():
        for d, start, end in sorted(own)[1:]:
            expected[d] |= set(range(start, end))
    got = {r.doc: {k for c in r.cuts for k in range(c.start, c.end)} for r in spans.covered(table(spark, rows)).collect()}
    assert got == dict(expected)
    assert {r.doc_id: r.text for r in spans.dedup_spans(table(spark, rows[:2])).collect()}[2].split() == "Its own first words. Its own last words.".split()


# Near duplicates


def components(rows, k, percent):
    sets = {}
    for d, t in rows:
        own = WORD.findall(ascii_lower(t or ""))
        sets[d] = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_cases():
    noise = random.Random(9)
    bank = ["w%d" % k for k in range(4000)]
    rows = [(d, t) for d, t in ODD if d is not None] + [(40, "One two"), (41, "one TWO"), (42, "one two three")]
    base = [noise.choice(bank) for _ in range(160)]
    for k in range(200):  # more than two blocks, similarities around the threshold
        own = list(base)
        for _ in range(noise.randint(0, 7)):
            own[noise.randrange(len(own))] = noise.choice(bank)
        rows.append((1000 + k, " ".join(own)))
    for g in range(25):
        own = [noise.choice(bank) for _ in range(noise.randint(3, 60))]
        for c in range(3):
            rows.append((2000 + 10 * g + c, " ".join(own)))
            own = own + [noise.choice(bank)] if c else own
    return rows + [(3000 + k, rows[40][1]) for k in range(50)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent):
    rows = near_cases()
    noise = random.Random(1)
    noise.shuffle(rows)
    expected = components(rows, k, percent)
    got = neardup.near_duplicates(table(spark, rows), neardup.Settings(k, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_broadcast(spark):
    rows = near_cases()[:120]
    docs = table(spark, rows)
    groups = spark.createDataFrame([(d, 1) for d, _ in rows], "node long, component long")
    few = neardup.verified_links(docs, groups, neardup.Settings(3, 85), "doc_id", "text", broadcast_rows=0)
    label = {r.node: r.component for r in neardup.components(few).collect()}
    expected = components(rows, 3, 85)
    assert {d: label.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in expected.items()}


def test_odd_rows_and_one_of_each(spark):
    rows = [(None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (4, "one two three four five six"), (6, None), (6, "")]
    docs = table(spark, rows)
    got = sorted(map(repr, neardup.near_duplicates(docs).collect()))
    assert got.count("Row(doc_id=5, n_shingles=2, component_id=4, kept=False)") == 2
    assert "Row(doc_id=None, n_shingles=2, component_id=None, kept=True)" in got
    left = neardup.one_of_each(docs)
    assert left.columns == docs.columns and sorted(map(repr, [r.doc_id for r in left.collect()])) == ["4", "6", "6", "None"]


def test_sketch_estimates():
    random_ = np.random.default_rng(0)
    buckets = 336
    for share, size in ((0.9, 50), (0.85, 2000), (0.5, 300), (0.0, 40)):
        errors = []
        for _ in range(20):
            a = random_.integers(0, 1 << 63, size).astype(np.uint64)
            common = int(round(2 * size * share / (1 + share)))
            b = np.concatenate([a[:common], random_.integers(0, 1 << 63, size - common).astype(np.uint64)])
            true = common / (2 * size - common)
            n = np.array([size])
            errors.append(neardup.estimates([neardup.sketch(a, buckets)], [neardup.sketch(b, buckets)], n, n)[0, 0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.12


# Decontamination


def test_words_past_the_last_window():
    """A slice whose only known words lie past the start of the last window."""
    index = decontam.Index([(1, "what is the name of the river here? alpha beta")])
    leak = "zz " * 40 + "What is the name of the river here? alpha beta " + "yy " * 20
    assert index.leaks(["zz " * 30 + "river", None, "", "river", leak]) == [{}, {}, {}, {}, {1: (1.0, 1.0, 1.0)}]


def test_very_long_text_is_searched_in_stretches(monkeypatch):
    monkeypatch.setattr(decontam, "STRETCH", 1000)
    noise = random.Random(12)
    items = [(k, " ".join(noise.choice("abcdefghijklmnop") * 3 + str(noise.randint(0, 99)) for _ in range(20)) + f"? answer {k} is here now") for k in range(60)]
    index = decontam.Index(items)
    for _ in range(20):
        chosen = noise.sample(items, 4)
        parts = [" ".join(noise.choice("qrstuvw") * 4 for _ in range(noise.randint(0, 3000))) for _ in range(5)]
        text = " ".join(part + " " + item for part, (_, item) in zip(parts, chosen)) + " " + parts[4]
        assert set(index.leaks(["x", text, "y"])[1]) == {k for k, _ in chosen}
    words = " ".join(noise.choice(["some", "other", "words", "here"]) for _ in range(1_000_000))
    assert set(index.leaks([words + " " + items[3][1]])[0]) == {3}


def test_partitions_of_one_row(spark):
    benchmark = spark.createDataFrame([(1, "what is the name of the river here? alpha beta")], "item_id long, text string")
    texts = [(k, "zz " * (k % 40) + ("river" if k % 3 else "")) for k in range(60)] + [(99, "so what is the name of the river here? alpha beta")]
    docs = table(spark, texts).repartition(61)
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()] == [(99, 1)]
    assert decontam.without_leaks(docs, benchmark).count() == 60


def test_index_retrieves_all_above_threshold():
    noise = random.Random(6)
    bank = ["".join(noise.choice("abcde") for _ in range(noise.randint(1, 4))) for _ in range(400)]
    items = [(k, " ".join(noise.choice(bank) for _ in range(noise.randint(4, 40)))) for k in range(150)]
    index = decontam.Index(items)
    words = []
    for k in range(400):
        words += [noise.choice(bank) for _ in range(noise.randint(0, 30))]
        if k % 3 == 0:
            own = decontam.tokens(noise.choice(items)[1])
            words += own[:noise.randint(1, len(own))]
    # Brute force over the same windows, every item scored in full.
    n_of = Counter(w for _, t in items for w in set(decontam.tokens(t)))
    mean = np.mean([len(decontam.tokens(t)) for _, t in items])
    texts = [words, [], words[:37], ["unheard"], words[500:]]
    expected = set()
    for which, words, (item, text) in ((k, w, i) for k, w in enumerate(texts) for i in items):
        own = Counter(decontam.tokens(text))
        size = sum(own.values())
        impact = {w: np.log1p((len(items) - n_of[w] + 0.5) / (n_of[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in own.items()}
        width = 1 << max(3, (size - 1).bit_length())
        for first in range(0, max(1, len(words) - width), width):
            window = set(words[first:first + 2 * width])
            if sum(v for w, v in impact.items() if w in window) >= decontam.SHARE * sum(impact.values()) - 1e-9:
                expected.add((which, item, first))
    assert {(which, item, first) for which, item, _, first, _ in index.retrieve(texts)} == expected and len(expected) > 100


def test_leaks(spark):
    noise = random.Random(8)
    items = [(1, "What is the largest whale alive today? The blue whale is."), (2, passage(noise, 30)), (3, None), (4, "..."), (None, "x y z"), (2, passage(noise, 9))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    text2 = {r["item"]: r["text"] for r in benchmark.selectExpr("item_id item", "text").dropDuplicates(["item"]).collect()}[2]
    rows = ODD + [(50, f"{passage(noise, 300)} what is the LARGEST whale alive today the blue whale is {passage(noise, 50)}"),
                  (51, f"{passage(noise, 33)} {text2} {passage(noise, 500)}"), (52, passage(noise, 400)), (53, "The blue whale is large."), (51, text2)]
    found = decontam.find_leaks(table(spark, rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(50, 1), (51, 2), (51, 2)]
    assert all(r.question_overlap == 1.0 for r in found)
    clean = decontam.without_leaks(table(spark, rows), benchmark)
    assert clean.columns == table(spark, rows).columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {50, 51}


def test_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_ITEMS", 3)
    noise = random.Random(8)
    items = [(k, passage(noise, 25)) for k in range(11)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [(k, f"{passage(noise, 40)} {t} end") for k, t in items] + [(99, passage(noise, 60))])
    assert len(list(decontam.indexes(benchmark))) > 1
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()} == {(k, k) for k in range(11)}
    assert [r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()] == [99]


# Empty tables


def test_several_indexes_score_as_one(spark, monkeypatch):
    noise = random.Random(8)
    bank = ["".join(noise.choice("abcde") for _ in range(5)) for _ in range(120)]
    items = [(k, " ".join(noise.choice(bank[:10 + k]) for _ in range(noise.randint(8, 30))) + (" ?" if k % 2 else "")) for k in range(60)] + [(60, " . "), (61, None)]
    rows = []
    for k in range(200):
        own = noise.choice(items[:60])[1].split()
        rows.append((k, " ".join([noise.choice(bank) for _ in range(5)] + own[:int(len(own) * noise.uniform(0.4, 0.9))])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    told = lambda: {(r.doc_id, r.item_id): round(r.score, 9) for r in decontam.find_leaks(table(spark, rows), benchmark).collect()}
    one = told()
    monkeypatch.setattr(decontam, "INDEX_ITEMS", 30)
    assert told() == one and len(one) > 50


def test_empty_tables(spark):
    docs = table(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for frame in (lines.dedup_lines(docs), packing.pack(docs, path()), spans.dedup_spans(docs), neardup.near_duplicates(docs),
                  neardup.one_of_each(docs), decontam.find_leaks(docs, benchmark), decontam.without_leaks(docs, benchmark)):
        assert frame.collect() == []
    assert decontam.find_leaks(table(spark, ODD), benchmark).collect() == []
