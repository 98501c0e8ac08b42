"""Typed values from configuration text, as column expressions; what can't be read becomes the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of a duration's suffixes (fixed values).
DURATIONS = {
    1_000: ("ms", "millisecond", "milliseconds"), 1_000_000: ("s", "sec", "second", "seconds"),
    60_000_000: ("m", "min", "minute", "minutes"), 3_600_000_000: ("h", "hr", "hour", "hours"),
}
YES, NO = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def number(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def clamped(text: Column, default: float, low: float, high: float) -> Column:
    return F.least(F.greatest(number(text, default), F.lit(float(low))), F.lit(float(high)))


def boolean(text: Column, default: bool) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False).otherwise(default)


def chosen(text: Column, default: str, allowed: tuple[str, ...]) -> Column:
    return F.when(text.isin(*allowed), text).otherwise(default)


def matching(text: Column, default: str, pattern: str) -> Column:
    """The text if the whole of it matches."""
    return F.when(F.regexp_like(text, F.lit(f"^(?:{pattern})$")), text).otherwise(default)


def duration_us(text: Column, default_us: int, unit_us: int = 1_000_000) -> Column:
    """Microseconds of a whole number with a suffix; without one, or with an unknown one, in ``unit_us``."""
    whole = F.regexp_extract(text, r"^(-?[0-9]+)", 1).try_cast("long")
    suffix = F.lower(F.regexp_extract(text, r"^[0-9.\-]+\s*(.*)$", 1))
    scale = F
    for us, names in DURATIONS.items():
        scale = scale.when(suffix.isin(*names), F.lit(us))
    return F.coalesce(whole * scale.otherwise(F.lit(unit_us)), F.lit(default_us))


def items(text: Column) -> Column:
    """Trimmed, non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
