"""Time-grid expressions: durations, bins, day arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_UNITS = {"s": 1, "sec": 1, "min": 60, "h": 3600, "d": 86400, "day": 86400, "days": 86400}


def seconds(duration: str | int) -> int:
    """``"5min"``, ``"6h"``, ``"1d"`` or a number of seconds."""
    if isinstance(duration, int):
        return duration
    found = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", duration)
    if not found or found.group(2) not in _UNITS:
        raise ValueError(f"not a duration: {duration!r}")
    return int(found.group(1)) * _UNITS[found.group(2)]


def grid_seconds(freq: str | int) -> int:
    """Bin width; it must divide a day so that bins start at midnight for every series."""
    step = seconds(freq)
    if step <= 0 or 86400 % step:
        raise ValueError(f"bin width must divide 24 h: {freq!r}")
    return step


def bin_index(ts: Column, step: int) -> Column:
    """Number of the left-closed bin holding ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(step * 1_000_000)).cast("bigint")


def bin_start(index: Column, step: int) -> Column:
    return F.timestamp_seconds(index * F.lit(step))


def days_between(later: Column, earlier: Column) -> Column:
    """Signed difference in days with fractions."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def at_midnight(day: Column) -> Column:
    return day.cast("timestamp")


def rounded(value: Column, digits: int) -> Column:
    """Round half up. The tiny shift makes values that are exact decimal halves round up however
    the last bits of a floating-point sum fell."""
    return F.round(value + F.lit(1e-10), digits) + F.lit(0.0)
