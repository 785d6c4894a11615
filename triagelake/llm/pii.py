"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is one projection. A cheap test sends only texts that can hold a kind through its patterns;
places come from the lengths of the matches and of the text between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from triagelake.llm.native import bind, counted, joined, spans


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap necessary test, a starting score and the words that raise it."""

    name: str
    pattern: str
    may_hold: str
    start: float
    context: str
    base: bool


# Possessive runs and edges give the matches of the plain patterns without their backtracking.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]", 0.6, "ip|host|address|server", True),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|mobile|fax", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11}|\x20[A-Z0-9]{4}\x20)", 0.7, "iban|account|bank", False),
    Kind("ssn", r"[0-9]++(?:-[0-9]++)++", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security", False),
)
NAMES = [k.name for k in KINDS]
#: A kind outside the base needs this score; context adds, a missing checksum drops the span.
THRESHOLD, CONTEXT_GAIN = 0.5, 0.3
#: Context words count in so many characters on either side of a span.
NEARBY = 48
#: Groups of four, of which some may be an IBAN as it is printed; only the last may be shorter.
_PRINTED = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}(?![A-Z0-9]))++(?:\x20[A-Z0-9]{1,3}(?![A-Z0-9]))?+"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """The card checksum over the digits of a string."""
    def total(number: Column) -> Column:
        values = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: bind(
            number.substr(F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
        return F.aggregate(values, F.lit(0), lambda a, v: a + v)

    return bind(digits(found), lambda number: total(number) % 10 == 0)


def mod97(found: Column) -> Column:
    """The account checksum: letters as 10 to 35, the first four characters last, remainder 1."""
    turned = F.concat(found.substr(F.lit(5), F.length(found)), found.substr(1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,score:double>>"


def _confirmed(kind: str, s: Column) -> Column:
    found = s["found"]
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3)
                        & (F.right(p, F.lit(4)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(found)).between(14, 19) & luhn(found)
    if kind == "phone":
        return F.length(digits(found)).between(10, 15)
    if kind == "iban":
        return F.length(found).between(15, 34) & mod97(found)
    if kind == "ssn":
        return found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~found.rlike("^(000|666|9)|-00-|0000$")
    return F.lit(True)


def _printed_ibans(text: Column) -> Column:
    """Confirmed accounts in groups of four as (start, end): from each free group the longest that passes."""
    places = "array<struct<start:bigint,end:bigint>>"
    none = F.array().cast(places)

    def inside(s: Column) -> Column:
        size = F.length(s["found"])

        def best(i: Column) -> Column:
            ends = F.transform(F.sequence(F.lit(9), F.lit(4)), lambda groups: F.least(5 * (i + groups) - 1, size))
            plain = lambda end: F.replace(s["found"].substr(5 * i + 1, end - 5 * i), F.lit(" "), F.lit(""))
            passing = F.filter(ends, lambda end: bind(plain(end), lambda x: x.rlike("^[A-Z]{2}[0-9]{2}.{11,30}$") & F.when(F.length(x) >= 15, mod97(x))))
            return F.transform(F.slice(passing, 1, 1), lambda end: F.struct(
                (s["start"] + 5 * i).alias("start"), (s["start"] + end).cast("long").alias("end")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((size - 1) / 5).cast("int")), none, lambda out, i: F.when(
            F.coalesce(F.try_element_at(out, F.lit(-1))["end"] > s["start"] + 5 * i, F.lit(False)), out).otherwise(F.concat(out, best(i)).cast(places)))

    return F.coalesce(F.flatten(F.transform(spans(text, _PRINTED), inside)), none)


def _of_kind(text: Column, number: int, kind: Kind) -> Column:
    """The confirmed spans of one kind with their scores."""
    may = F.contains(text, F.lit("@")) if kind.may_hold == "@" else text.rlike(kind.may_hold)
    if kind.name == "phone":
        may = F.contains(text, F.lit("+")) & may
    around = lambda s: F.concat_ws(
        "\n", text.substr((F.greatest(s["start"] - NEARBY, F.lit(0)) + 1).cast("int"), F.least(s["start"], F.lit(NEARBY)).cast("int")),
        text.substr((s["end"] + 1).cast("int"), F.lit(NEARBY)))
    scored = lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"),
        (F.lit(kind.start) + F.when(F.lower(around(s)).rlike(f"(?:{kind.context})"), CONTEXT_GAIN).otherwise(0.0)).alias("score"))
    found = F.transform(F.filter(spans(text, kind.pattern), lambda s: _confirmed(kind.name, s)), scored)
    if kind.name == "iban":
        found = F.concat(F.coalesce(found, F.array().cast(_SPAN)), F.transform(_printed_ibans(text), scored))
    return F.when(may, found if kind.base else F.filter(found, lambda s: s["score"] >= THRESHOLD))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: the spans (start, kind, end, score) of every row by start, then kind.

    A null text is an empty one and has no spans. Places are code points, ends exclusive; failing
    matches are dropped without another try, but for accounts printed in groups of four. Context words
    count in the whole text within 48 characters on either side. Base kinds stay at any score. Repeated rows come out
    repeated, a null id stays null, other columns are not carried, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = [F.coalesce(_of_kind(text, n, k).cast(_SPAN), F.array().cast(_SPAN)) for n, k in enumerate(KINDS)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sort_array(F.concat(*each)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    base = F.filter("found", lambda s: s["kind"] < sum(k.base for k in KINDS))
    counts = [counted(F.col("found"), n).alias(f"n_{k}") for n, k in enumerate(NAMES)]
    return found.select("doc_id", *counts, F.sha2(joined(base, NAMES).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("found"), NAMES).alias("spans"))
