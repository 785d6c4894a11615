"""Wall-clock time helpers and do-not-disturb windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, independent of any time zone."""
    seconds = (
        F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    )
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


def from_micros(micros: Column) -> Column:
    """Wall-clock timestamp back from ``epoch_micros``."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(86400000000.0)


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Days rounded toward minus infinity."""
    return F.floor((epoch_micros(later) - epoch_micros(earlier)) / F.lit(86400000000.0)).cast("int")


def recency(days_ago: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days_ago) / F.lit(half_life))


_WINDOW = r"^\s*(\d{1,2}):(\d{1,2})\s*-\s*(\d{1,2}):(\d{1,2})\s*$"


def dnd_bounds(raw: Column) -> tuple[Column, Column]:
    """Start and end as minutes of the day; both null when the text is not a window."""
    parts = [F.regexp_extract(raw, _WINDOW, i).try_cast("int") for i in (1, 2, 3, 4)]
    valid = (parts[0] <= 23) & (parts[1] <= 59) & (parts[2] <= 23) & (parts[3] <= 59)
    return (
        F.when(valid, parts[0] * 60 + parts[1]),
        F.when(valid, parts[2] * 60 + parts[3]),
    )


def dnd_columns(created_at: Column, raw: Column) -> dict[str, Column]:
    """Half-open window that may wrap midnight; equal bounds mean never."""
    start, end = dnd_bounds(raw)
    minute = F.hour(created_at) * 60 + F.minute(created_at)
    # Bounds fall on whole minutes, so a minute-of-day comparison equals the full one.
    inside = (
        F.when(start.isNull() | (start == end), F.lit(False))
        .when(start < end, (minute >= start) & (minute < end))
        .otherwise((minute >= start) | (minute < end))
    )
    return {
        "dnd_window_raw": raw,
        "dnd_start": start,
        "dnd_end": end,
        "dnd_wraps_midnight": F.coalesce(start > end, F.lit(False)),
        "in_dnd": inside,
        "minutes_until_dnd_ends": F.when(inside, F.pmod(end - minute, F.lit(1440))),
    }


def parse_iso(text: Column) -> Column:
    """Zone-less timestamp from ISO text; a trailing Z is accepted."""
    bare = F.regexp_replace(F.trim(text), "Z$", "")
    return bare.try_cast("timestamp_ntz")
