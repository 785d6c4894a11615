"""Typed reading of text columns and contract checks on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from triagelake import config as C
from triagelake.functions.text import python_strip
from triagelake.functions.timewin import parse_iso
from triagelake.functions.vocab import boolean_word

_INTEGER = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$"


class ContractError(ValueError):
    """A table breaks its contract."""


def _blank_null(text: Column) -> Column:
    return F.nullif(python_strip(text), F.lit(""))


def parse_field(text: Column, kind: str) -> Column:
    """Trimmed and typed value; null when blank or malformed."""
    value = _blank_null(text)
    if kind == "int":
        return F.when(value.rlike(_INTEGER), value).try_cast("long")
    if kind == "float":
        return F.when(value.rlike(_FLOAT), value).try_cast("double")
    if kind == "bool":
        return boolean_word(value)
    if kind == "datetime":
        return F.when(value.rlike(_STAMP), parse_iso(value))
    if kind == "date":
        return F.when(value.rlike(_DATE), value).try_cast("date")
    if kind == "raw":
        return F.coalesce(text, F.lit(""))
    if kind == "label":
        return F.lower(value)
    return value


def field_error(text: Column, name: str, kind: str, required: bool) -> Column:
    """Message for a blank required field or an unreadable value, else null."""
    if kind == "raw":
        return F.lit(None).cast("string")
    blank = _blank_null(text).isNull()
    unreadable = ~blank & parse_field(text, kind).isNull()
    missing = F.when(blank, f"{name}: blank") if required else F.when(F.lit(False), "")
    return missing.when(unreadable, f"{name}: not a valid {kind}")


def apply_schema(raw: DataFrame, schema: dict[str, tuple[str, bool]]) -> DataFrame:
    """Typed columns plus ``_errors``; ``schema`` maps a name to (kind, required)."""
    checks = [field_error(F.col(n), n, kind, required) for n, (kind, required) in schema.items()]
    extra = [c for c in raw.columns if c not in schema]
    return raw.select(
        *[parse_field(F.col(n), kind).alias(n) for n, (kind, _) in schema.items()], *extra,
        F.array_compact(F.array(*checks)).alias("_errors"),
    )


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows without the error column, and the rows that broke the contract."""
    return parsed.filter(F.size("_errors") == 0).drop("_errors"), parsed.filter(F.size("_errors") > 0)


def require_clean(parsed: DataFrame, name: str) -> DataFrame:
    """Typed rows; raises on the first broken ones."""
    good, bad = split_quarantine(parsed)
    first = bad.select("_errors").head(3)
    if first:
        raise ContractError(f"{name}: {[r['_errors'] for r in first]}")
    return good


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    first = duplicate_keys(df, keys).head(3)
    if first:
        raise ContractError(f"{name}: duplicate key {[tuple(r)[:-1] for r in first]}")
    return df


def id_difference(left: DataFrame, right: DataFrame, key: str = "message_id") -> DataFrame:
    """Ids on one side only; empty when both tables key the same set."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.filter(F.col("l") != F.col("r")).select(key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def require_same_ids(left: DataFrame, right: DataFrame, name: str) -> None:
    first = id_difference(left, right).head(3)
    if first:
        raise ContractError(f"{name}: ids differ: {[tuple(r) for r in first]}")


# --- Contract of the submitted file ----------------------------------------------------

_NUMBER_WORD = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"


def output_row_errors(rows: DataFrame, messages: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of a submitted file with the list of rules each one breaks.

    ``rows`` holds the six contract columns as text, ``line_number`` and perhaps ``file_errors``.
    Cited ids are resolved by a join, so neither the history nor the ids are held in one place.
    """
    text = {c: F.coalesce(c, F.lit("")) for c in C.OUTPUT_COLUMNS}
    found = F.col("file_errors") if "file_errors" in rows.columns else F.array().cast("array<string>")
    out = rows.select("line_number", found.alias("_file"), *[v.alias(c) for c, v in text.items()]).withColumn("_id", F.trim("message_id"))
    evidence = F.trim("evidence_message_ids")
    parts = F.transform(F.split(evidence, ";", -1), lambda p: F.trim(p))
    cited = out.select("line_number", F.explode(F.when((evidence != "") & (evidence != C.NO_EVIDENCE), parts)).alias("cited"))
    known = history.select(F.col("message_id").alias("cited")).distinct()
    unresolved = cited.join(known, "cited", "left_anti").select("line_number", F.lit(True).alias("_unresolved")).distinct()
    repeated = duplicate_keys(out.filter("_id <> ''"), ["_id"]).select("_id", F.lit(True).alias("_repeated"))
    expected = messages.select(F.col("message_id").alias("_id"), F.lit(True).alias("_expected")).distinct()
    joined = out.join(unresolved, "line_number", "left").join(repeated, "_id", "left").join(expected, "_id", "left")
    confidence = F.trim("confidence")
    numeric = confidence.rlike(_NUMBER_WORD)
    number = F.when(numeric, F.regexp_replace(confidence, "(?i)^[+-]?(nan|inf|infinity)$", "2")).try_cast("double")
    checks = [(F.col(c).rlike("[\r\n]"), f"embedded newline in {c}") for c in C.OUTPUT_COLUMNS] + [
        (F.col("_id") == "", "blank message_id"),
        (~F.trim("action").isin(*C.ACTIONS), "invalid action"),
        (~F.trim("message_type").isin(*C.MESSAGE_TYPES), "invalid message_type"),
        (F.col("reason").rlike("[\r\n]"), "reason must be a single line"),
        (~numeric, "confidence is not a number"),
        (numeric & ~number.between(0.0, 1.0), "confidence outside [0, 1]"),
        (evidence == "", "evidence missing"),
        (F.col("_unresolved").isNotNull(), "unresolved evidence ids"),
        (F.col("_repeated").isNotNull(), "duplicate message_id"),
        ((F.col("_id") != "") & F.col("_expected").isNull(), "unknown message_id"),
    ]
    errors = F.concat("_file", F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks])))
    return joined.select("line_number", "message_id", errors.alias("errors"))


def output_file_summary(rows: DataFrame, messages: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Counts of the file-level rules: rows, duplicate ids, missing and extra ids."""
    found = rows.select(F.trim("message_id").alias("message_id"))
    tagged = found.select("message_id", F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(
        messages.select("message_id", F.lit(0).alias("f"), F.lit(1).alias("e")))
    sides = tagged.groupBy("message_id").agg(F.sum("f").alias("f"), F.max("e").alias("e"))
    keyed = F.col("message_id") != ""
    summary = sides.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("row_count"),
        F.count_if(keyed & (F.col("f") > 1)).alias("duplicate_ids"),
        F.count_if(keyed & (F.col("f") == 0)).alias("missing_ids"),
        F.count_if(keyed & (F.col("e") == 0)).alias("extra_ids"),
        F.count_if(F.col("e") == 1).alias("expected_ids"),
    )
    expected = F.col("expected_ids") if expected_rows is None else F.lit(expected_rows)
    return summary.withColumn("row_count_ok", F.col("row_count") == expected)
