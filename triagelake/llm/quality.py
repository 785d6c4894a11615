"""Quality rules as a bitmask ledger.

Every measurement and every rule is worked out once per document, in one projection without a
shuffle. The ledger keeps the measurements and one bit per failed rule. A policy is a named, versioned
set of bits; applying one, and asking what each rule contributes, are bitwise operations on the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from triagelake.llm.native import bind

WINDOW = 5
_BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


#: Rules by bit, lowest first; each says when a document fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 6 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "100 * n_capitals > 50 * word_chars",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("training", 1, tuple(RULES))


def _repeated(words: Column) -> Column:
    """Words inside windows of five that are in the text twice or more."""
    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(sorted_: Column) -> Column:
        n = F.size(sorted_)
        return F.sort_array(F.transform(F.filter(F.transform(sorted_, lambda s, k: F.struct(
            s["i"].alias("i"), (((k > 0) & (sorted_[F.greatest(k - 1, F.lit(0))]["h"] == s["h"]))
                                | ((k < n - 1) & (sorted_[F.least(k + 1, n - 1)]["h"] == s["h"]))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))

    def count(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), bind(bind(ordered, twice), covered)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, bind(hashes, count)).otherwise(F.lit(0).cast("long"))


def _measured(text: Column) -> Column:
    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        _repeated(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(text, _BLANKS, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(bind(words, of_words).alias("w"), bind(lines, of_lines).alias("l"),
                    F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                    F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_capitals"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed_bits`` of every row.

    A null text is an empty one: no words, no lines, and it fails ``few_words`` only. Windows are told
    apart by 64-bit hashes within one text. Repeated rows come out repeated, a null id stays null,
    other columns are not carried, an empty table gives no rows.
    """
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), _measured(F.coalesce(F.col(text_col), F.lit(""))).alias("m")).select(
        "doc_id", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines", "m.n_capitals")
    bits = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def passes(policy: Policy, bits: Column | str = "failed_bits") -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """What each rule does under each policy: policy, version, rule, documents, kept, kept_without, fails_alone.

    One count per bit pattern leaves the ledger, at most two to the number of rules; the rest is
    bitwise work on those counts. Without documents there are no rows.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    asked = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"),
                               F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
                      for p in policies for r in p.rules])
    each = patterns.select("failed_bits", "n", F.explode(asked).alias("q")).select("failed_bits", "n", "q.*")
    failed = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("documents"), F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"))
