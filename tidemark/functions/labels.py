"""Metric names, labels, and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_pairs(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def metric_key(name: Column, labels: Column) -> Column:
    """``name;k=v;k=v`` with the keys in order."""
    return F.concat(name, F.array_join(F.transform(sorted_pairs(labels), lambda e: F.concat(F.lit(";"), e["key"], F.lit("="), e["value"])), ""))


def fingerprint(name: Column, labels: Column) -> Column:
    """``name{k=v,k=v,}`` with the keys in order."""
    return F.concat(name, F.lit("{"), F.array_join(F.transform(sorted_pairs(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(","))), ""), F.lit("}"))


def group_key(group: Column, labels: Column, by: list[str]) -> Column:
    """The group, then each label's value and a colon; a missing label counts as empty."""
    return F.concat(group, F.lit(":"), *[F.concat(label(labels, k), F.lit(":")) for k in by]) if by else group


def label(labels: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(key)), F.lit(""))


def matches_all(wanted: Column, labels: Column) -> Column:
    """Whether every wanted pair is among the labels; a missing label equals an empty one."""
    return F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.try_element_at(labels, e["key"]), F.lit("")) == e["value"])


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def poly31_32(text: Column) -> Column:
    """The polynomial hash with base 31, modulo 2^32."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


def prometheus_name(name: Column) -> Column:
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")
    return F.when(clean.rlike("^[a-zA-Z_:]"), clean).otherwise(F.concat(F.lit("_"), clean))


def statsd_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[.\s]+", "_")


def contains_any(name: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.lower(name).contains(p)
    return found


def inferred_type(name: Column, timers: bool = False) -> Column:
    """counter, histogram, summary, timer or gauge, by what the name contains."""
    out = F.when(contains_any(name, ("count", "total", "requests")), "counter")
    out = out.when(contains_any(name, ("time", "duration", "latency")), "timer") if timers else out.when(contains_any(name, ("histogram", "bucket")), "histogram").when(contains_any(name, ("summary", "quantile")), "summary")
    return out.otherwise("gauge")


def escaped(value: Column) -> Column:
    """Backslashes, double quotes and line ends of a label value."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def masked_user(user: Column) -> Column:
    n = F.length(user)
    return F.when(n <= 2, F.lit("**")).otherwise(F.concat(F.left(user, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(user, F.lit(1))))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with each ``${name}`` replaced; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def message(template: Column, values: dict[str, Column], value: Column) -> Column:
    """A template column with each ``${name}`` replaced, and ``${value}`` by the number with two decimals; unknown names stay."""
    out = F.replace(template, F.lit("${value}"), F.format_string("%.2f", value))
    for name, v in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(v, F.lit("")))
    return out


def unclosed_template(template: Column) -> Column:
    return template.rlike(r"\$\{[^}]*$")


def traceparent(trace_id: Column, span_id: Column, flags: Column) -> Column:
    return F.concat_ws("-", F.lit("00"), trace_id, span_id, flags)


def parsed_traceparent(header: Column) -> Column:
    """Struct of trace id, span id and flags; null if shorter than 55 characters or without its four parts."""
    parts = F.split(header, "-")
    return F.when((F.length(header) >= 55) & (F.size(parts) >= 4), F.struct(parts[1].alias("trace_id"), parts[2].alias("span_id"), parts[3].alias("flags")))


def retry_delay(kind: str, attempt: Column, base_ms: int, cap_ms: int, factor: float = 2.0) -> Column:
    """Milliseconds before retry ``attempt`` (from 1): fixed, linear, exponential or Fibonacci, at most ``cap_ms``."""
    if kind == "fixed":
        out = F.lit(base_ms).cast("double")
    elif kind == "linear":
        out = attempt * float(base_ms)
    elif kind == "exponential":
        out = base_ms * F.pow(F.lit(factor), attempt - 1)
    elif kind == "fibonacci":
        one = F.lit(1).cast("long")
        start = F.struct(one.alias("a"), one.alias("b"))
        # 90 numbers are as many as fit; all later ones are above any cap
        out = base_ms * F.when(attempt <= 1, one).otherwise(F.aggregate(F.sequence(F.lit(2), F.least(attempt, F.lit(90))), start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")))["a"]).cast("double")
    else:
        raise ValueError(f"no such kind of delay: {kind}")
    return F.least(out, F.lit(float(cap_ms)))
