"""Tumbling window keys over epoch seconds, and the ranges of the admin queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a window by granularity letter, and how many newest windows are kept.
SPANS = {"d": 86_400, "h": 3_600, "m": 300}
KEEP = {"d": 32, "h": 170, "m": 13}
#: Seconds of a named range, and its granularity.
RANGES = {"1h": (3_600, "m"), "24h": (86_400, "h"), "7d": (604_800, "d"), "30d": (2_592_000, "d")}


def floor_div(x: Column, n: int) -> Column:
    """Integer division that rounds down for negative numbers too."""
    return ((x - F.pmod(x, F.lit(n))) / n).cast("long")


def window_ord(ts: Column, granularity: str) -> Column:
    return floor_div(ts, SPANS[granularity])


def window_key(ts: Column, granularity: str) -> Column:
    """``d19723``: the granularity letter and the window's ordinal."""
    return F.concat(F.lit(granularity), window_ord(ts, granularity).cast("string"))


def ord_of_key(key: Column) -> Column:
    """Ordinal of a window key; what is not a number sorts before everything."""
    return F.coalesce(F.substring(key, 2, 30).try_cast("bigint"), F.lit(-(1 << 63)))


def is_since_shape(key: Column) -> Column:
    return key.rlike(r"^[dhm]-?\d+$")


def window_start(ts: Column, granularity: str) -> Column:
    return window_ord(ts, granularity) * SPANS[granularity]


def parse_range(raw: str) -> tuple[str, int, str]:
    """(name, seconds, granularity) of a range; blanks and capitals are forgiven, all else is not."""
    name = raw.strip().lower()
    if name not in RANGES:
        raise ValueError(f"unknown range {raw!r}")
    return (name, *RANGES[name])


def civil_day(ts: Column) -> Column:
    """``YYYY-MM-DD`` in UTC, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ts, 86_400).cast("int")).cast("string")
