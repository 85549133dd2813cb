"""Time helpers.  All work on ``timestamp_ntz`` with the session in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_second(ts: Column) -> Column:
    """Drop sub-second digits; keeps the wall-clock type ``timestamp_ntz``."""
    return F.date_trunc("second", ts).cast("timestamp_ntz")


def to_wall_clock(ts: Column) -> Column:
    """Zone-aware instant -> UTC wall clock without zone."""
    return ts.cast("timestamp_ntz")


def parse_timestamp(text: Column, fmt: str | None = None, lenient: bool = False) -> Column:
    """Text -> ``timestamp_ntz``.  Strict by default (bad text raises under
    ANSI); ``lenient`` turns bad text into null."""
    if lenient:
        parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    else:
        parsed = F.to_timestamp(text, fmt) if fmt else F.to_timestamp(text)
    return to_wall_clock(parsed)


def days_between_boundaries(start: Column, end: Column) -> Column:
    """Number of midnights crossed from ``start`` to ``end`` (calendar days)."""
    return F.datediff(F.to_date(end), F.to_date(start))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def days_elapsed(start: Column, end: Column) -> Column:
    """Whole elapsed days, floored: 23:59:59 later is 0, one second early is -1."""
    return F.floor((epoch_seconds(end) - epoch_seconds(start)) / F.lit(86400)).cast("int")


def years_between(start: Column, end: Column) -> Column:
    """Number of year boundaries crossed (not elapsed years)."""
    return F.year(end) - F.year(start)
