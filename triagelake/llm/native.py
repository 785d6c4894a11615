"""Expression helpers for the operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from operator import add

from pyspark.sql import Column, functions as F

#: Length of the pieces in which running sums are made.
_PIECE = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.transform(F.array(value), use)[0]


def _scan(steps: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """0 and the running folds of a short array."""
    return F.aggregate(steps, F.array(F.lit(0).cast("long")),
                       lambda sums, step: F.concat(sums, F.array(fold(F.element_at(sums, -1), step))))


def running(steps: Column, fold: Callable[[Column, Column], Column] = add) -> Column:
    """The running sums of an array of longs, each element included; pieces keep the work linear.

    Another ``fold`` must be associative and leave a value as it is when it meets 0.
    """
    def joined(pieces: Column) -> Column:
        return bind(_scan(F.transform(pieces, lambda p: F.element_at(p, -1)), fold), lambda before: F.flatten(
            F.transform(pieces, lambda p, at: F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: fold(x, before[at])))))

    cut = bind(steps, lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _PIECE).cast("int")), lambda k: _scan(F.slice(s, k * _PIECE + 1, _PIECE), fold)))
    return bind(cut, joined)


def spans(text: Column, pattern: str, group: int = 0, before: int = 48) -> Column:
    """Leftmost non-overlapping matches in order: array of (start, end, found, value, before).

    Places are code points, ends exclusive; ``value`` is a group of the pattern and ``before`` the end
    of the text between the match and the one before it.
    """
    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"),
                       F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def place(x: Column) -> Column:
        steps = F.transform(x["m"], lambda _, i: (F.length(x["g"][i]) + F.when(i > 0, F.length(x["m"][i - 1])).otherwise(0)).cast("long"))
        return bind(running(steps), lambda starts: F.transform(x["m"], lambda found, i: F.struct(
            starts[i].alias("start"), (starts[i] + F.length(found)).alias("end"), found.alias("found"),
            x["v"][i].alias("value"), F.right(x["g"][i], F.lit(before)).alias("before"))))

    return bind(matches, lambda x: F.when(F.size(x["m"]) > 0, place(x)))


def counted(found: Column, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of (start, kind number, end) structs, comma-joined by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
