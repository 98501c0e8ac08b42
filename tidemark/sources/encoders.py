"""Metrics, spans and alerts as text lines and JSON, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import escaped, inferred_type, prometheus_name, sorted_pairs, statsd_name


def exporter_rows(df: DataFrame, origin: str, origin_col: Column, defaults: dict[str, str], instance: str = "") -> DataFrame:
    """``name, value, labels``: origin (component or source), then default labels, tags and instance; the later wins."""
    maps = [F.create_map(F.lit(origin), origin_col), F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else None, F.col("tags"), F.create_map(F.lit("instance"), F.lit(instance)) if instance else None]
    entries = F.concat(*[F.map_entries(m) for m in maps if m is not None])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    labels = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    return df.withColumn("labels", labels)


def prometheus_text(name: Column, value: Column, labels: Column, ms: Column, kind: Column, help_text: str = "") -> Column:
    pairs = F.array_join(F.transform(sorted_pairs(labels), lambda e: F.concat(prometheus_name(e["key"]), F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    n = prometheus_name(name)
    line = F.concat(n, F.when(F.cardinality(labels) > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), value.cast("string"), F.lit(" "), ms.cast("string"))
    return F.concat(F.lit("# HELP "), n, F.lit(f" {help_text}\n# TYPE "), n, F.lit(" "), kind, F.lit("\n"), line)


def statsd_line(name: Column, value: Column, kind: Column, rate: float = 1.0, tags: Column | None = None) -> Column:
    code = F.when(kind == "counter", "c").when(kind == "gauge", "g").when(kind == "timer", "ms").when(kind == "histogram", "h").when(kind == "set", "s").otherwise("g")
    out = F.concat(statsd_name(name), F.lit(":"), value.cast("string"), F.lit("|"), code, F.lit(f"|@{rate:g}" if rate < 1 else ""))
    if tags is None:
        return out
    pairs = F.array_join(F.transform(sorted_pairs(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return F.concat(out, F.when(F.cardinality(tags) > 0, F.concat(F.lit("|#"), pairs)).otherwise(""))


def influx_line(name: Column, value: Column, tags: Column, us: Column) -> Column:
    def safe(c: Column) -> Column:
        return F.regexp_replace(c, "([, =])", r"\\$1")

    pairs = F.array_join(F.transform(sorted_pairs(tags), lambda e: F.concat(F.lit(","), safe(e["key"]), F.lit("="), safe(e["value"]))), "")
    return F.concat(safe(name), pairs, F.lit(" value="), value.cast("string"), F.lit(" "), (us * 1000).cast("string"))


def otlp_metric(name: Column, value: Column, labels: Column, us: Column, monotonic: Column) -> Column:
    attributes = F.transform(sorted_pairs(labels), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    point = F.array(F.struct(attributes.alias("attributes"), (us * 1000).cast("string").alias("timeUnixNano"), value.alias("asDouble")))
    total = F.struct(F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"), point.alias("dataPoints"))
    return F.to_json(F.struct(name.alias("name"), F.when(monotonic, total).alias("sum"), F.when(~monotonic, F.struct(point.alias("dataPoints"))).alias("gauge")))


def zipkin_span(s: dict[str, Column]) -> Column:
    """Zipkin v2 JSON; ``s`` has trace_id, span_id, parent_id, name, start_us, duration_us, service, tags."""
    return F.to_json(F.struct(
        s["trace_id"].alias("traceId"), s["span_id"].alias("id"), s["parent_id"].alias("parentId"), s["name"].alias("name"), s["start_us"].alias("timestamp"), s["duration_us"].alias("duration"),
        F.struct(s["service"].alias("serviceName")).alias("localEndpoint"), s["tags"].alias("tags")))


def jaeger_span(s: dict[str, Column]) -> Column:
    tags = F.transform(sorted_pairs(s["tags"]), lambda e: F.struct(e["key"].alias("key"), F.lit("string").alias("vType"), e["value"].alias("vStr")))
    return F.to_json(F.struct(
        F.xxhash64(s["trace_id"]).alias("traceIdLow"), F.lit(0).alias("traceIdHigh"), F.xxhash64(s["span_id"]).alias("spanId"), F.coalesce(F.xxhash64(s["parent_id"]), F.lit(0)).alias("parentSpanId"),
        s["name"].alias("operationName"), s["start_us"].alias("startTime"), s["duration_us"].alias("duration"), tags.alias("tags")))


#: OTLP's numbers of span kinds and status codes (fixed values).
OTLP_KINDS = {"internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
OTLP_STATUS = {"ok": 1, "error": 2}


def otlp_span(s: dict[str, Column]) -> Column:
    """OTLP JSON of a span: ``trace_id, span_id, parent_id`` in hexadecimal, ``name, start_us, end_us, tags``, ``service``.

    Kind and status come from control tags, the other tags are attributes in order of their keys.
    """
    kind, status, rest = otel_span(s["tags"])
    number = lambda column, codes: F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), column)
    attributes = F.transform(sorted_pairs(F.map_concat(rest, F.create_map(F.lit("service.name"), s["service"]))), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    return F.to_json(F.struct(
        s["trace_id"].alias("traceId"), s["span_id"].alias("spanId"), s["parent_id"].alias("parentSpanId"), s["name"].alias("name"), number(kind, OTLP_KINDS).alias("kind"),
        (s["start_us"] * 1000).cast("string").alias("startTimeUnixNano"), (s["end_us"] * 1000).cast("string").alias("endTimeUnixNano"), attributes.alias("attributes"), F.struct(number(status, OTLP_STATUS).alias("code")).alias("status")))


def exported(df: DataFrame, form: str) -> DataFrame:
    """Rows ``name, value, tags, us`` as ``text`` in one of ``FORMATS``."""
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}; there are {', '.join(FORMATS)}")
    return df.select(FORMATS[form](F.col("name"), F.col("value"), F.col("tags"), F.col("us")).alias("text"))


FORMATS = {
    "prometheus": lambda name, value, tags, us: prometheus_text(name, value, tags, F.floor(us / 1000), inferred_type(name)),
    "statsd": lambda name, value, tags, us: statsd_line(name, value, inferred_type(name, timers=True), tags=tags),
    "influx": lambda name, value, tags, us: influx_line(name, value, tags, us),
    "otlp": lambda name, value, tags, us: otlp_metric(name, value, tags, us, inferred_type(name) == "counter"),
}


CONTROL_TAGS = ("span.kind", "error", "error.message")


def otel_span(tags: Column) -> tuple[Column, Column, Column]:
    """Kind, status and remaining attributes of a span from its tags; the status comes from the ``error`` tag."""
    kind = F.coalesce(F.try_element_at(tags, F.lit("span.kind")), F.lit("internal"))
    status = F.when(F.coalesce(F.try_element_at(tags, F.lit("error")), F.lit("false")).isin("true", "1"), "error").otherwise("ok")
    return kind, status, F.map_filter(tags, lambda k, _: ~k.isin(*CONTROL_TAGS))


def baggage_headers(baggage: Column) -> Column:
    return F.transform_keys(baggage, lambda k, _: F.concat(F.lit("baggage-"), k))


def extracted_baggage(headers: Column) -> Column:
    return F.transform_keys(F.map_filter(headers, lambda k, _: F.startswith(k, F.lit("baggage-"))), lambda k, _: F.substr(k, F.lit(9)))


def alert_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in ("name", "severity", "state", "value", "labels") if c in df.columns]))


def alert_text(name: Column, severity: Column, state: Column, value: Column) -> Column:
    return F.format_string("[%s] %s is %s (value %.2f)", F.upper(severity), name, state, value)


def inferred(name: Column) -> Column:
    return inferred_type(name)
