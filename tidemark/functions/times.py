"""Time arithmetic that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ (or TIMESTAMP, taken in the session's zone)."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def step_start(us: Column, start_us: int, step_us: int) -> Column:
    """Start of the step that holds a time, steps being counted from ``start_us`` rather than from the epoch."""
    return F.lit(start_us) + F.floor((us - start_us) / step_us).cast("long") * step_us
