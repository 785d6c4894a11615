"""Secrets: fixed patterns, and character Markov models that tell random strings from identifiers.

Two first-order character models are trained from the labelled strings of all documents: values that the
fixed patterns find are random strings, the other words are ordinary. A long string whose log-likelihood
ratio exceeds a limit is a span of its own; the limit comes from labelled strings that the models have not
seen. Training and scoring are DataFrame functions; what reaches the driver is one count per pair of
characters and label, and one per label and whole number of the ratio.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from triagelake.llm.native import bind, counted, joined, running, spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
STRING = r"[A-Za-z0-9+/_=-]{16,}"
NAMES = ["assign", "access", "hex", "random"]
N_BASE = 3
#: Letters of an ordinary word that is learned.
TRAIN_WORD = r"[A-Za-z0-9+/_=-]{5,}"
#: Characters a string can have.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Share of the uniform distribution in the single-character model of ordinary and of random strings, and
#: the weight, in pairs, that this model has in each row of the pair model.
UNIFORM, ROW_PRIOR = (0.05, 0.5), 20.0
#: One in so many strings, by a hash, is held back from the models; the limit is set on these, and there an
#: ordinary string that is told costs as much as so many that are missed.
HOLD_BACK, FALSE_COST = 5, 100.0
#: The limit where no strings of both labels are held back, and the one preferred among equally good ones.
PRIOR_ODDS = 14.0
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _values(text: Column) -> Column:
    """The strings that the fixed patterns find."""
    return F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6),
                    F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """label (1: random), s and held of the distinct strings of all documents."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    strings = texts.select(F.lit(1).alias("label"), F.explode(_values(F.col("text"))).alias("s")).unionByName(
        texts.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(plain, F.lit(TRAIN_WORD), F.lit(0))).alias("s")))
    # Equal strings count once: a copied document teaches nothing new.
    return strings.where(F.length("s") >= 2).distinct().withColumn("held", F.pmod(F.xxhash64("s", F.lit("held")), F.lit(HOLD_BACK)) == 0)


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each pair of characters at 128 * first + second.

    Strings that are held back are not learned. Without strings of both labels the ratios are zero, so
    nothing is called random.
    """
    strings = labelled(docs, text_col).where(~F.col("held"))
    pairs = strings.select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"))
    counts = np.zeros((2, 128, 128))
    for row in pairs.groupBy("label", "pair").count().collect():  # at most two per pair of characters
        a, b = map(ord, row["pair"])
        if a < 128 and b < 128:
            counts[row["label"], a, b] = row["count"]
    used = [ord(c) for c in SYMBOLS]
    ratio = np.zeros((128, 128))
    own, logs = counts[:, used][:, :, used], []
    if not own.sum(axis=(1, 2)).all():
        return ratio.ravel()
    for pairs_, uniform in zip(own, UNIFORM):
        single = (1 - uniform) * pairs_.sum(axis=0) / pairs_.sum() + uniform / len(used)
        logs.append(np.log((pairs_ + ROW_PRIOR * single) / (pairs_.sum(axis=1, keepdims=True) + ROW_PRIOR)))
    ratio[np.ix_(used, used)] = logs[1] - logs[0]
    return ratio.ravel()


def ratio_of(found: Column, ratios: np.ndarray) -> Column:
    """Summed log-likelihood ratio of a string's pairs of characters; a pair that comes again says no more."""
    table = F.lit(ratios)
    codes = F.transform(F.split(found, ""), lambda c: F.ascii(c))
    pairs = bind(codes, lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(k) - 1), lambda i: k[i - 1] * 128 + k[i])))
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.get(table, p), F.lit(0.0)))


def held_back(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """label, s and ratio of the strings that the models have not seen and that could be a span."""
    kept = labelled(docs, text_col).where(F.col("held") & F.col("s").rlike(f"^{STRING}$"))
    return kept.select("label", "s", ratio_of(F.col("s"), ratios).alias("ratio"))


def limit_of(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> float:
    """The log-likelihood ratio that a string must exceed to be called random.

    It is the whole number at which the held-back strings cost least: the share of random ones missed, plus
    ``FALSE_COST`` times the share of ordinary ones told. Of equally good limits the one next to
    ``PRIOR_ODDS`` is taken. A secret that no fixed pattern knows counts as ordinary and costs the same at all limits below it, so a few
    of them move nothing. Without held-back strings of both labels the limit is ``PRIOR_ODDS``.
    """
    steps = held_back(docs, ratios, text_col).groupBy("label", F.ceil("ratio").cast("int").alias("step")).count().collect()
    of = [{r["step"]: r["count"] for r in steps if r["label"] == label} for label in (0, 1)]
    if not of[0] or not of[1]:
        return PRIOR_ODDS
    limits = np.arange(min(min(of[0]), min(of[1])) - 1, max(max(of[0]), max(of[1])) + 1)
    told = [np.array([sum(c for step, c in side.items() if step > limit) for limit in limits]) / sum(side.values()) for side in of]
    cost = 1 - told[1] + FALSE_COST * told[0]
    best = limits[cost <= cost.min() + 1e-12]
    return float(best[np.argmin(abs(best - PRIOR_ODDS))])


def _of(text: Column, may: Column, kind: int, pattern: str, keep=None, group: int = 0) -> Column:
    found = spans(text, pattern, group)
    if keep is not None:
        found = F.filter(found, keep)
    short = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.coalesce(F.when(may, short).cast(_SPAN), F.array().cast(_SPAN))


def _told_once(every: Column) -> Column:
    """Sorted spans less the random ones that lie in a span of a fixed pattern.

    Such a pattern begins no later, so the furthest end of the fixed ones so far tells.
    """
    ends = F.transform(every, lambda s: F.when(s["kind"] < N_BASE, s["end"]).otherwise(0))
    return bind(running(ends, F.greatest), lambda reach: F.filter(every, lambda s, i: (s["kind"] < N_BASE) | (reach[i] < s["end"])))


def find(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", limit: float = PRIOR_ODDS) -> DataFrame:
    """doc_id and ``found``: the spans (start, kind, end) of every row by start, then kind.

    A random string inside a span of a fixed pattern is not told again. A null text is an empty one and
    has no spans. Places are code points, ends exclusive. Repeated rows come out repeated, a null id
    stays null, other columns are not carried, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assigns = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN)
    base = F.concat(_of(text, assigns, 0, ASSIGN, lambda s: F.length(s["value"]) >= 6, 2),
                    _of(text, F.contains(text, F.lit("AKIA")), 1, ACCESS), _of(text, text.rlike(HEX), 2, HEX))
    random = _of(text, text.rlike(STRING), 3, STRING, lambda s: ratio_of(s["found"], ratios) > limit)
    both = F.struct(base.alias("base"), random.alias("random"))
    found = bind(both, lambda x: F.when(F.size(x["random"]) == 0, F.sort_array(x["base"])).otherwise(
        bind(F.sort_array(F.concat(x["base"], x["random"])), _told_once)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed patterns and of random strings, the hash of the base spans, all spans as text."""
    base = F.filter("found", lambda s: s["kind"] < N_BASE)
    counts = [counted(F.col("found"), n).alias(f"n_{k}") for n, k in enumerate(NAMES)]
    return found.select("doc_id", *counts, F.sha2(joined(base, NAMES).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("found"), NAMES).alias("spans"))
