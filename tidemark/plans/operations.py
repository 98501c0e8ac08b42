"""Queries of rules, active alerts, notifications, similarities, samples, spans and exports, each with its DuckDB statement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import labels as L
from ..operators import aggregates as A
from ..operators import alerts as AL
from ..operators import derived, folds, graphs, ordering, rules
from ..operators import series as S
from ..operators import triggers as T
from ..sources import encoders as E
from .registry import ALERTS, DAY, HOUR, MINUTE, ORACLE_SQL, SPANS, STATES_SQL, T0, alerts, checks, edges, evaluated, metrics, query, read, rounded, spans, states_sql

# --- rules ----------------------------------------------------------------------------------------------------------

#: line, rule, metric, kind, op, threshold, severity, hold, repeat, enabled: as texts, some of them wrong.
TEXTS = (
    (1, "slow", "click", "", ">", "150.5", "", "5m", "1h", "true"), (2, "errors", "error", "threshold", ">=", "100", "critical", "90 sec", "", "yes"),
    (3, "quiet", "view", "absent", "", "", "info", "", "250ms", "on"), (4, "fast", "purchase", "rate", "", "x", "emergency", "7", "2 weeks", "0"),
    (5, "", "click", "", "", "", "", "", "", ""), (6, "none", "", "", "", "", "", "", "", ""), (7, "kind", "view", "magic", "", "", "", "", "", ""),
    (8, "op", "view", "threshold", "=>", "", "", "", "", ""), (9, "loud", "view", "", "<>", "1", "shout", "", "", "off"), (10, "slow", "view", "", "=", "2", "", "", "", "maybe"),
)
TEXT = "line int, rule string, metric string, kind string, op string, threshold string, severity string, hold string, repeat string, enabled string"
TEXTS_SQL = "x(line, rule, metric, kind0, op0, threshold0, severity0, hold, again, enabled0) AS (VALUES " + ", ".join(map(str, TEXTS)) + ")"


def duration_sql(c: str, default: int) -> str:
    n, s = f"try_cast(regexp_extract({c}, '^(-?[0-9]+)', 1) AS BIGINT)", f"lower(regexp_extract({c}, '^[0-9.\\-]+\\s*(.*)$', 1))"
    scale = " ".join(f"WHEN {s} IN ({', '.join(repr(x) for x in names)}) THEN {us}" for us, names in C.DURATIONS.items())
    return f"coalesce({n} * CASE {scale} ELSE 1000000 END, {default})::BIGINT"


def rules_sql(source: str) -> str:
    """Statement tables ``r`` of the rules defined by ``source``, a table ``x`` of texts."""
    return f"""WITH {{m}}, {source}, t AS (SELECT line, rule, metric, CASE WHEN kind0 = '' THEN 'threshold' ELSE kind0 END AS kind,
  CASE WHEN op0 IN ('>', '') THEN '>' WHEN op0 IN ('>=', '<', '<=', '==', '!=') THEN op0 WHEN op0 = '=' THEN '==' WHEN op0 = '<>' THEN '!=' END AS op, coalesce(try_cast(threshold0 AS DOUBLE), 0) AS threshold,
  CASE WHEN severity0 = '' THEN 'warning' ELSE severity0 END AS severity, {duration_sql('hold', 0)} AS hold_us, {duration_sql('again', 300_000_000)} AS repeat_us,
  CASE WHEN enabled0 IN ('true', '1', 'yes', 'on') THEN true WHEN enabled0 IN ('false', '0', 'no', 'off') THEN false ELSE true END AS enabled FROM x),
r AS (SELECT *, CASE WHEN rule = '' THEN 'no name' WHEN metric = '' THEN 'no metric' WHEN kind NOT IN ('threshold', 'rate', 'anomaly', 'absent') THEN 'unknown kind' WHEN kind = 'threshold' AND op IS NULL THEN 'unknown operator'
  WHEN severity NOT IN ('info', 'warning', 'critical', 'emergency') THEN 'unknown severity' WHEN row_number() OVER (PARTITION BY rule ORDER BY line) > 1 THEN 'repeated name' END AS problem FROM t)"""


RULES_SQL = rules_sql(TEXTS_SQL)
#: Values that the rules of the parts table take in turn, by part number.
TURNS = {
    "kind": ("", "threshold", "rate", "absent", "magic", "anomaly"), "op": (">", ">=", "<", "=", "<>", "=>", "", "!="), "severity": ("", "info", "critical", "emergency", "shout"),
    "hold": ("5m", "90 sec", "", "7", "2 weeks", "1 Hours", "x"), "repeat": ("1h", "250ms", "", "soon"), "enabled": ("true", "yes", "0", "", "maybe", "off", "on"),
}


def part_rules(spark, sf_dir):
    """A rule's texts for each part: its brand and type as names, its size as threshold, the other texts in turn."""
    turn = {n: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % len(v) + 1).cast("int")).alias(n) for n, v in TURNS.items()}
    rule = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 2).cast("string")))
    size = F.when(F.col("p_partkey") % 9 == 0, "x").otherwise(F.col("p_size").cast("string"))
    metric = F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), rule.alias("rule"), metric.alias("metric"), turn["kind"], turn["op"], size.alias("threshold"), turn["severity"], turn["hold"], turn["repeat"], turn["enabled"])


PART_SQL = "x AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand || '/' || (p_partkey // 2) END AS rule, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS metric, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_size::VARCHAR END AS threshold0, "
PART_SQL += ", ".join(f"[{', '.join(map(repr, v))}][(p_partkey % {len(v)})::INT + 1] AS {sql}" for (n, v), sql in zip(TURNS.items(), ("kind0", "op0", "severity0", "hold", "again", "enabled0"), strict=True)) + " FROM part)"


def texts(spark):
    return rules.defined(spark.createDataFrame(TEXTS, TEXT))


@query(rules_sql(PART_SQL) + " SELECT * FROM r")
def rule_definitions(spark, sf_dir):
    return rules.defined(part_rules(spark, sf_dir))


@query(RULES_SQL + """ SELECT rule, severity, row_id FROM m JOIN r ON name = metric WHERE enabled AND problem IS NULL AND kind = 'threshold' AND CASE op WHEN '>' THEN value > threshold ELSE value >= threshold END""")
def configured_alerts(spark, sf_dir):
    return AL.threshold_alerts(metrics(spark, sf_dir), texts(spark).where("problem IS NULL AND kind = 'threshold'")).select("rule", "severity", "row_id")


SOURCES = {"click": "response_time", "purchase": "request_count", "error": "error_count", "signup": "cpu_usage", "view": "memory_usage"}
SOURCE_SQL = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}_agg'" for a, b in SOURCES.items()) + " END"


@query(f"""WITH {{m}}, x AS (SELECT {SOURCE_SQL} AS prefix, us // {MINUTE} * {MINUTE} AS window_start, value FROM m),
s AS (SELECT prefix, window_start, avg(value) AS mean, min(value) AS lo, max(value) AS hi, coalesce(stddev_samp(value), 0) AS sd, count(*) AS n, quantile_cont(value, [0.5, 0.9, 0.95, 0.99]) AS q, list(value) AS v, CASE prefix WHEN 'error_count_agg' THEN 2 ELSE 3 END AS k FROM x GROUP BY prefix, window_start),
c AS (SELECT prefix, window_start, unnest([{{'n': 'mean', 'v': mean}}, {{'n': 'min', 'v': lo}}, {{'n': 'max', 'v': hi}}, {{'n': 'stddev', 'v': sd}}, {{'n': 'count', 'v': n::DOUBLE}}, {{'n': 'p50', 'v': q[1]}}, {{'n': 'p90', 'v': q[2]}}, {{'n': 'p95', 'v': q[3]}}, {{'n': 'p99', 'v': q[4]}},
  {{'n': 'rate', 'v': CASE WHEN prefix IN ('request_count_agg', 'error_count_agg') THEN n / 60.0::DOUBLE END}}, {{'n': 'outlier_count', 'v': CASE WHEN prefix <> 'request_count_agg' THEN len(list_filter(v, lambda y: abs(y - mean) > k * sd))::DOUBLE END}}]) AS e FROM s)
SELECT prefix || '.' || e.n AS metric, window_start, round(e.v, 6) AS value FROM c WHERE e.v IS NOT NULL""")
def standard_rules(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    return rounded(rules.aggregated(metrics(spark, sf_dir).withColumn("name", F.element_at(names, F.col("name"))), rules.standard(spark)), "value")


@query("""WITH x AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_type || (p_partkey % 40) END AS source_metric, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS prefix, (p_size - 3)::BIGINT AS interval_us FROM part)
SELECT *, CASE WHEN source_metric = '' THEN 'no source' WHEN prefix = '' THEN 'no prefix' WHEN interval_us <= 0 THEN 'no interval' WHEN row_number() OVER (PARTITION BY source_metric ORDER BY line) > 1 THEN 'repeated source' END AS problem FROM x""")
def rule_checks(spark, sf_dir):
    k = F.col("p_partkey")
    source = F.when(k % 17 == 0, "").otherwise(F.concat("p_type", (k % 40).cast("string")))
    return rules.checked(read(spark, sf_dir, "part").select(k.alias("line"), source.alias("source_metric"), F.when(k % 5 == 0, "").otherwise(F.col("p_brand")).alias("prefix"), (F.col("p_size") - 3).cast("long").alias("interval_us")))


UNITS = ("ms", " sec", "m", " Hours", " weeks", "")


@query(f"""WITH {{m}}, x AS (SELECT row_id, k || [{', '.join(repr(u) for u in UNITS)}][(row_id % 6)::INT + 1] AS t, name, k || ', ,' || name AS l FROM m)
SELECT row_id, {duration_sql('t', -1)} AS duration_us, least(greatest(coalesce(try_cast(t AS DOUBLE), 7), 10), 50) AS clamped, CASE WHEN name IN ('click', 'view') THEN name ELSE 'other' END AS chosen,
  CASE WHEN regexp_full_match(name, '[a-e].*') THEN name ELSE '-' END AS matched, len(list_filter([trim(y) FOR y IN string_split(l, ',')], lambda y: y <> ''))::INT AS items FROM x""")
def config_values(spark, sf_dir):
    units = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("row_id") % 6 + 1).cast("int"))
    x = metrics(spark, sf_dir).select("row_id", "name", F.concat(F.col("tags")["k"], units).alias("t"), F.concat(F.col("tags")["k"], F.lit(", ,"), "name").alias("l"))
    return x.select(
        "row_id", C.duration_us(F.col("t"), -1).alias("duration_us"), C.clamped(F.col("t"), 7, 10, 50).alias("clamped"), C.chosen(F.col("name"), "other", ("click", "view")).alias("chosen"),
        C.matching(F.col("name"), "-", "[a-e].*").alias("matched"), F.size(C.items(F.col("l"))).alias("items"))


# --- alerts ---------------------------------------------------------------------------------------------------------

#: The newest state of each name and user's evaluations.
NEWEST_SQL = states_sql("key", "name || '/' || user_id", 30) + ", l AS (SELECT key, arg_max({'state': state, 'us': s.us, 'value': value}, rn) AS z FROM s JOIN e USING (key, rn) GROUP BY key)"


def user_states(spark, sf_dir):
    m = metrics(spark, sf_dir).select(F.concat_ws("/", "name", F.col("tags")["user_id"]).alias("key"), "us", "row_id", "value", (F.col("value") > 30).alias("met"))
    return AL.states(m, ["key"], ["us", "row_id"], "met", 10 * MINUTE)


@query(NEWEST_SQL + " SELECT key, CASE WHEN key LIKE 'click/%' AND ends_with(key, '7') THEN 'resolved' ELSE z.state END AS state, z.us AS us, z.value AS value FROM l WHERE z.state IN ('pending', 'firing')")
def active_alerts(spark, sf_dir):
    active = AL.active(user_states(spark, sf_dir), ["key"], ["us", "row_id"])
    by_hand = metrics(spark, sf_dir).where("name = 'click'").select(F.concat_ws("/", "name", F.col("tags")["user_id"]).alias("key")).where("endswith(key, '7')").distinct()
    return AL.resolved_by_hand(active, by_hand)


@query(NEWEST_SQL + f" SELECT key, z.state AS state, z.us AS us FROM l WHERE z.state <> 'resolved' OR {T0 + 29 * DAY} - z.us <= {12 * HOUR}")
def remembered_alerts(spark, sf_dir):
    return AL.remembered(user_states(spark, sf_dir), ["key"], ["us", "row_id"], T0 + 29 * DAY, 12 * HOUR)


@query(STATES_SQL + f""", o AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY name ORDER BY rn), 'inactive') AS before FROM s),
n AS (SELECT name, rn, us, state, 0::BIGINT AS last, false AS sent FROM o WHERE rn = 1 UNION ALL SELECT o.name, o.rn, o.us, o.state,
  CASE WHEN o.state = 'firing' AND (o.before <> 'firing' OR o.us - n.last >= {2 * HOUR}) THEN o.us ELSE n.last END,
  (o.state = 'firing' AND (o.before <> 'firing' OR o.us - n.last >= {2 * HOUR})) OR (o.state = 'resolved' AND o.before = 'firing') FROM n JOIN o ON o.name = n.name AND o.rn = n.rn + 1)
SELECT name, state, us, count(*) AS sent FROM n WHERE sent GROUP BY ALL""")
def repeat_notifications(spark, sf_dir):
    return AL.notifications(evaluated(spark, sf_dir), ["name"], ["us", "row_id"], 2 * HOUR).groupBy("name", "state", "us").agg(F.count("*").alias("sent"))


@query(f"""WITH RECURSIVE {{m}}, {ALERTS}, f AS (SELECT k, us, id, (row_number() OVER (PARTITION BY k, fingerprint ORDER BY us, id) = 1)::INT AS new FROM a),
g AS (SELECT k, us, id, sum(new) OVER o AS size, min(us) OVER o AS first FROM f WINDOW o AS (PARTITION BY k ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, id) AS rn FROM g WHERE us - first >= {6 * HOUR}),
c AS (SELECT k, rn, us, id, size, us AS last, true AS pass FROM e WHERE rn = 1 UNION ALL SELECT e.k, e.rn, e.us, e.id, e.size, CASE WHEN e.us - c.last >= {DAY} THEN e.us ELSE c.last END, e.us - c.last >= {DAY} FROM c JOIN e ON e.k = c.k AND e.rn = c.rn + 1)
SELECT k, us, id, size::BIGINT AS size FROM c WHERE pass""")
def group_flushes(spark, sf_dir):
    return AL.group_flushes(alerts(spark, sf_dir).withColumn("k", F.col("labels")["k"]), ["k"], 6 * HOUR, DAY)


@query(f"WITH {{m}}, {ALERTS} SELECT severity, count(*) AS alerts, max(us) AS last_us, arg_max(id, (us, id)) AS last_id FROM a GROUP BY severity")
def alert_summary(spark, sf_dir):
    return AL.severity_summary(alerts(spark, sf_dir))


@query(f"WITH {{m}}, {ALERTS} SELECT id FROM a WHERE NOT ((regexp_matches(fingerprint, '^(click|view).*user_id=1') AND us >= {T0} AND us < {T0 + 20 * DAY}) OR (contains(fingerprint, 'k=7,') AND us >= {T0 + DAY} AND us < {T0 + 9 * DAY}))")
def pattern_silences(spark, sf_dir):
    return AL.silenced_by_pattern(alerts(spark, sf_dir), [("^(click|view).*user_id=1", True, T0, T0 + 20 * DAY), ("k=7,", False, T0 + DAY, T0 + 9 * DAY)]).select("id")


@query(f"""WITH {{m}}, {ALERTS}, n AS (SELECT *, lead(k) OVER o AS k2, lead(user_id) OVER o AS u2, lead(us) OVER o AS us2, lead(fingerprint) OVER o AS f2 FROM a WINDOW o AS (PARTITION BY name ORDER BY us, id))
SELECT id, CASE WHEN k = k2 AND user_id = u2 THEN 1.0 WHEN k = k2 OR user_id = u2 THEN round(1 / 3.0::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS label_similarity, round(greatest(1 - abs(us2 - us) / {HOUR}, 0), 6)::DOUBLE AS time_similarity,
  round(1 - levenshtein(fingerprint, f2) / greatest(length(fingerprint), length(f2), 1), 6) AS text_similarity FROM n WHERE k2 IS NOT NULL""")
def alert_similarity(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("name").orderBy("us", "id")
    a = alerts(spark, sf_dir).withColumn("next", F.lead(F.struct("labels", "us", "fingerprint")).over(w)).where("next IS NOT NULL")
    return rounded(a.select(
        "id", AL.label_similarity(F.col("labels"), F.col("next.labels")).alias("label_similarity"), AL.time_similarity(F.col("us"), F.col("next.us"), HOUR).alias("time_similarity"),
        AL.text_similarity(F.col("fingerprint"), F.col("next.fingerprint")).alias("text_similarity")), "label_similarity", "time_similarity", "text_similarity")


@query(f"""WITH {{m}}, {ALERTS}, g AS (SELECT name, us // {HOUR} AS hour, count(*) AS size, count(DISTINCT k) AS ks, min(k) AS k, count(DISTINCT user_id) AS users, min(user_id) AS user_id FROM a GROUP BY ALL)
SELECT name, hour, size, concat_ws(',', CASE WHEN ks = 1 THEN 'k=' || k END, CASE WHEN users = 1 THEN 'user_id=' || user_id END) AS common FROM g""")
def common_labels(spark, sf_dir):
    return AL.common_labels(alerts(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / HOUR)), ["name", "hour"])


@query("WITH p AS (SELECT event_type AS receiver, event_id, event_id % 4 AS priority, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 4 DESC, event_id) AS place FROM events), q AS (SELECT * FROM p WHERE place <= 1000) SELECT receiver, count(*) AS attempts, round(avg((event_id % 10 <> 0)::INT), 6) AS success_rate, min(priority) AS least_priority FROM q GROUP BY receiver")
def notification_queue(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("receiver"), "event_id", (F.col("event_id") % 4).alias("priority"))
    q = ordering.priority_buffer(e, ["receiver"], "priority", "event_id", 1000)
    r = derived.ratios(q.withColumn("ok", F.col("event_id") % 10 != 0), ["receiver"], "ok", "priority")
    return rounded(r.join(q.groupBy("receiver").agg(F.min("priority").alias("least_priority")), "receiver").select("receiver", "attempts", "success_rate", "least_priority"), "success_rate")


SUBSCRIPTIONS = (("audit", "click"), ("audit", "error"), ("pager", "error"), ("mail", "nothing"))


@query("WITH s(subscriber, event_type) AS (VALUES " + ", ".join(map(str, SUBSCRIPTIONS)) + ") SELECT subscriber, event_type, count(*) AS delivered, max(event_id) AS last_id FROM events JOIN s USING (event_type) GROUP BY ALL")
def event_subscriptions(spark, sf_dir):
    s = spark.createDataFrame(SUBSCRIPTIONS, "subscriber string, event_type string")
    return read(spark, sf_dir, "events").join(F.broadcast(s), "event_type").groupBy("subscriber", "event_type").agg(F.count("*").alias("delivered"), F.max("event_id").alias("last_id"))


# --- samples --------------------------------------------------------------------------------------------------------


@query(ORACLE_SQL["smoothing"].replace("0.7::DOUBLE", "0.01::DOUBLE"))
def slow_smoothing(spark, sf_dir):
    return rounded(S.smoothed(metrics(spark, sf_dir), "name", ["us", "row_id"], 0.01, DAY), "smoothed").select("name", "row_id", "smoothed")


@query("""WITH {m}, l AS (SELECT *, lag(us) OVER o AS u, lag(row_id) OVER o AS c FROM m WINDOW o AS (PARTITION BY name ORDER BY us, row_id)) SELECT name, row_id, CASE WHEN us > u THEN round(100.0 * (row_id - c) * 1000000 / ((us - u) * 1000), 6) END AS cpu_percent FROM l""")
def container_cpu(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("cpu_ns", F.col("row_id") * 1_000_000)
    return rounded(S.container_cpu(m, "name", ["us", "row_id"], DAY), "cpu_percent").select("name", "row_id", "cpu_percent")


@query("""WITH {m}, l AS (SELECT *, lag(value) OVER o AS v, lag(us) OVER o AS u FROM m WINDOW o AS (PARTITION BY name ORDER BY us, row_id)) SELECT name, row_id, coalesce(abs(value - v) > 50, false) AS delta, us - u AS gap_us FROM l""")
def sliced_changes(spark, sf_dir):
    m = S.with_previous(metrics(spark, sf_dir), "name", ["us", "row_id"], ["us", "value"], DAY)
    return m.select("name", "row_id", F.coalesce(F.abs(F.col("value") - F.col("previous.value")) > 50, F.lit(False)).alias("delta"), (F.col("us") - F.col("previous.us")).alias("gap_us"))


@query("WITH {m} SELECT row_id FROM m WHERE ('0x' || substr(md5(row_id::VARCHAR), 1, 8))::BIGINT < floor(0.25 * 4294967296)")
def sampled_metrics(spark, sf_dir):
    return S.sampled(metrics(spark, sf_dir), F.col("row_id"), 0.25).select("row_id")


@query("WITH {m} SELECT name, round(avg((row_id % 8 <> 0)::INT), 6) AS sample_rate FROM m GROUP BY name")
def effective_sample_rate(spark, sf_dir):
    return rounded(A.effective_sample_rate(metrics(spark, sf_dir).withColumn("kept", F.col("row_id") % 8 != 0), ["name"], "kept"), "sample_rate")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), c AS (SELECT o_orderpriority, count(*) AS calls, count(*) FILTER (WHERE o_orderstatus = 'F') AS errors FROM orders GROUP BY 1)
SELECT o_orderpriority, any_value(calls) AS calls, any_value(errors) AS errors, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
  round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(sum(o_totalprice), 2) AS total FROM r JOIN c USING (o_orderpriority) WHERE r <= 10000 GROUP BY o_orderpriority""")
def operation_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") != "F")
    return rounded(rounded(A.operation_metrics(o, "o_orderpriority", "o_totalprice", "ok", ["o_orderdate", "o_orderkey"]), "mean", "median", "p95", "p99", digits=4), "total", digits=2)


@query("""WITH n AS (SELECT event_id, event_type || ['_total', '_ms', '_bucket', ''][(event_id % 4)::INT + 1] AS name FROM events), t AS (SELECT *, CASE WHEN name LIKE '%\\_total' ESCAPE '\\' THEN 'counter' WHEN name LIKE '%bucket' THEN 'histogram' ELSE 'gauge' END AS kind FROM n) SELECT event_id, name FROM t WHERE kind IN ('counter', 'gauge') AND kind <> 'counter'""")
def type_filter(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, ("_total", "_ms", "_bucket", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    n = read(spark, sf_dir, "events").select("event_id", F.concat("event_type", suffix).alias("name"))
    return A.by_type(n, L.inferred_type(F.col("name")), ("counter", "gauge"), ("counter",))


@query("""WITH c AS (SELECT l_returnflag, unnest([{'c': 'load_1m', 'v': l_quantity}, {'c': 'load_5m', 'v': l_discount}, {'c': 'load_15m', 'v': l_tax}]) AS e FROM lineitem)
SELECT l_returnflag, e.c AS "column", count(*) AS count, round(avg(e.v), 6) AS mean, round(stddev_pop(e.v), 6) AS std_dev, min(e.v) AS min_value, max(e.v) AS max_value, round(quantile_cont(e.v, 0.95), 6) AS p95, round(quantile_cont(e.v, 0.99), 6) AS p99 FROM c GROUP BY ALL""")
def load_averages(spark, sf_dir):
    s = A.column_summaries(read(spark, sf_dir, "lineitem"), ["l_returnflag"], {"l_quantity": "load_1m", "l_discount": "load_5m", "l_tax": "load_15m"})
    return rounded(s.drop("total", "median"), "mean", "std_dev", "p95", "p99")


@query(f"""WITH {{m}}, p AS (SELECT name, us // {HOUR} AS hour, count(*)::DOUBLE AS volume, avg((value > 60)::INT) AS error_rate, avg(value) AS latency FROM m GROUP BY ALL),
b AS (SELECT *, avg(error_rate) OVER o AS e, avg(latency) OVER o AS l, avg(volume) OVER o AS v, stddev_samp(volume) OVER o AS s FROM p WINDOW o AS (PARTITION BY name ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT name, hour, coalesce(error_rate > 3 * e, false) AS error_spike, coalesce(latency > 2 * l, false) AS slow, coalesce(s > 1e-10 AND abs(volume - v) > 3 * s, false) AS odd_volume FROM b""")
def log_anomalies(spark, sf_dir):
    p = metrics(spark, sf_dir).groupBy("name", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").cast("double").alias("volume"), F.avg((F.col("value") > 60).cast("int")).alias("error_rate"), F.avg("value").alias("latency"))
    return T.log_anomalies(p, "name", "hour").select("name", "hour", "error_spike", "slow", "odd_volume")


@query(f"""WITH RECURSIVE {{m}}, d AS (SELECT name, us, row_id, CASE WHEN count(value) OVER o >= 3 AND min(value) OVER o > 40 THEN 'up' WHEN count(value) OVER o >= 3 AND max(value) OVER o < 5 THEN 'down' ELSE 'hold' END AS decision FROM m WINDOW o AS (PARTITION BY name ORDER BY us, row_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us, row_id) AS rn FROM d WHERE decision <> 'hold'),
c AS (SELECT name, rn, us, row_id, decision, us AS last, true AS pass FROM e WHERE rn = 1 UNION ALL SELECT e.name, e.rn, e.us, e.row_id, e.decision, CASE WHEN e.us - c.last >= {DAY} THEN e.us ELSE c.last END, e.us - c.last >= {DAY} FROM c JOIN e ON e.name = c.name AND e.rn = c.rn + 1)
SELECT name, row_id, decision FROM c WHERE pass""")
def scaling_cooldown(spark, sf_dir):
    d = T.scaling(metrics(spark, sf_dir), "name", ["us", "row_id"], 40.0, 5.0).where("decision <> 'hold'").select("name", "us", "row_id", "decision")
    return AL.cooled(d, ["name"], DAY).select("name", "row_id", "decision")


@query("WITH {m} SELECT row_id, value BETWEEN 20 AND 40 AS inside, NOT (value BETWEEN 20 AND 40) AS outside, NOT contains(name, 'i') AS without_i, regexp_matches(name, '^[cv]') AS starts, value % 7 AS rest, value <= 30 AS low FROM m")
def range_and_text_conditions(spark, sf_dir):
    v, name = F.col("value"), F.col("name")
    text = lambda op, x: T.condition({"field": "name", "op": op, "value": x})
    return metrics(spark, sf_dir).select("row_id", T.in_range(v, 20, 40).alias("inside"), T.in_range(v, 20, 40, inside=False).alias("outside"), text("not_contains", "i").alias("without_i"), text("regex", "^[cv]").alias("starts"), (v % 7).alias("rest"), (v <= 30).alias("low"))


@query("WITH {m} SELECT row_id, round(exp((ln(value + 1) + ln(row_id % 7 + 1)) / 2), 6) AS mean FROM m WHERE value > 42.5")
def registered_function(spark, sf_dir):
    """A user's function of a list of numbers, registered by name, in a statement with a bound parameter."""

    @F.pandas_udf("double")
    def geometric_mean(values: pd.Series) -> pd.Series:
        import numpy as np

        x = np.stack(values.to_numpy()) if len(values) else np.zeros((0, 1))
        return pd.Series(np.exp(np.log(x).mean(axis=1)))

    spark.udf.register("geometric_mean", geometric_mean)
    m = metrics(spark, sf_dir)
    return spark.sql("SELECT row_id, round(geometric_mean(array(value + 1, CAST(row_id % 7 + 1 AS DOUBLE))), 6) AS mean FROM {m} WHERE value > :low", args={"low": 42.5}, m=m)


@query("""WITH RECURSIVE {m}, e AS (SELECT name, us, least(100.0::DOUBLE, value) AS cpu, (row_id % 101)::DOUBLE AS memory, row_number() OVER (PARTITION BY name ORDER BY us, row_id) AS rn FROM m),
b AS (SELECT [0.0, 20.0, 40.0, 60.0, 80.0]::DOUBLE[] AS bounds, ['idle', 'low', 'moderate', 'high', 'critical'] AS names),
s AS (SELECT name, 0::BIGINT AS rn, NULL::BIGINT AS us, 0.0::DOUBLE AS cpu, 0.0::DOUBLE AS memory, 3 AS level, NULL::BIGINT AS since, false AS changed FROM (SELECT DISTINCT name FROM e)
UNION ALL SELECT name, rn, us, cpu, memory, CASE WHEN change THEN new ELSE level END AS level, CASE WHEN change THEN us ELSE since END AS since, change FROM (
  SELECT *, new <> level AND NOT (CASE WHEN new > level THEN load < bounds[level + 1] + 5 WHEN new < level THEN load > bounds[level] - 5 ELSE false END) AND (since IS NULL OR us - since >= 3600000000) AS change FROM (
    SELECT *, greatest(1, len(list_filter(bounds, lambda x: x <= load)))::INT AS new FROM (
      SELECT *, greatest(cpu, CASE WHEN memory > 85 THEN 81.0 WHEN memory > 70 THEN 61.0 ELSE 0.0 END) AS load FROM (
        SELECT e.name, e.rn, e.us, s.level, s.since, bounds, CASE WHEN s.since IS NULL THEN e.cpu ELSE 0.7::DOUBLE * e.cpu + (1 - 0.7::DOUBLE) * s.cpu END AS cpu, CASE WHEN s.since IS NULL THEN e.memory ELSE 0.7::DOUBLE * e.memory + (1 - 0.7::DOUBLE) * s.memory END AS memory FROM s JOIN e ON e.name = s.name AND e.rn = s.rn + 1, b)))))
SELECT name AS key, us, round(cpu, 6) AS cpu, round(memory, 6) AS memory, names[level] AS level, changed FROM s, b WHERE rn > 0""")
def load_level_changes(spark, sf_dir):
    e = metrics(spark, sf_dir).withColumns({"cpu": F.least(F.lit(100.0), "value"), "memory": F.col("row_id") % 101})
    return rounded(folds.adaptive_levels(e, "name", margin=5.0, cooldown_us=HOUR), "cpu", "memory")


# the same without rounding: both engines do the same double operations in the same order
ORACLE_SQL["adaptive_levels"] = ORACLE_SQL["load_level_changes"].replace("round(cpu, 6)", "cpu").replace("round(memory, 6)", "memory")


# --- health, traces, exports ----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'c' || c_custkey AS dependent, 'c' || (c_custkey // 2) AS dependency FROM customer WHERE c_custkey > 1), c AS (SELECT 'c' || c_custkey AS name, CASE WHEN c_acctbal < 0 THEN 'unhealthy' WHEN c_acctbal < 1000 THEN 'degraded' ELSE 'healthy' END AS status FROM customer),
b AS (SELECT DISTINCT dependent FROM e JOIN c ON dependency = name WHERE status = 'unhealthy') SELECT name, CASE WHEN status = 'healthy' AND name IN (SELECT dependent FROM b) THEN 'degraded' ELSE status END AS status FROM c""")
def dependent_health(spark, sf_dir):
    k = F.col("c_custkey")
    e = read(spark, sf_dir, "customer").where(k > 1).select(F.concat(F.lit("c"), k.cast("string")).alias("dependent"), F.concat(F.lit("c"), F.floor(k / 2).cast("string")).alias("dependency"))
    return graphs.with_dependencies(checks(spark, sf_dir), e).select("name", "status")


@query("WITH n AS (SELECT DISTINCT 'n' || c_nationkey AS dependency FROM customer) SELECT dependency, count(*) AS dependents FROM (SELECT 'n' || c_nationkey AS dependency FROM customer UNION ALL SELECT 'r' || n_regionkey FROM nation) GROUP BY dependency")
def dependents(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("dependency").agg(F.count("*").alias("dependents"))


@query(f"WITH {SPANS} SELECT span_id, operation, start_us, end_us FROM s WHERE trace_id = (SELECT min(l_orderkey) FROM lineitem)")
def trace_lookup(spark, sf_dir):
    s = spans(spark, sf_dir)
    return graphs.trace(s, s.agg(F.min("trace_id")).first()[0]).select("span_id", "operation", "start_us", "end_us")


@query(f"""WITH {SPANS}, t AS (SELECT trace_id, min(start_us) AS b FROM s GROUP BY trace_id ORDER BY b DESC, trace_id DESC LIMIT 10000), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_us, span_id) AS r FROM s WHERE trace_id IN (SELECT trace_id FROM t))
SELECT trace_id, count(*) AS spans FROM r WHERE r <= 1000 GROUP BY trace_id""")
def span_limits(spark, sf_dir):
    return graphs.capped_spans(spans(spark, sf_dir), ["start_us", "span_id"]).groupBy("trace_id").agg(F.count("*").alias("spans"))


@query(f"""WITH {SPANS} SELECT trace_id, span_id, '{{"traceId":"' || lpad(lower(to_hex(trace_id)), 32, '0') || '","spanId":"' || lpad(lower(to_hex(span_id)), 16, '0') || '",' || CASE WHEN parent_span_id IS NULL THEN '' ELSE '"parentSpanId":"' || lpad(lower(to_hex(parent_span_id)), 16, '0') || '",' END
  || '"name":"' || operation || '","kind":2,"startTimeUnixNano":"' || (start_us * 1000) || '","endTimeUnixNano":"' || (end_us * 1000) || '","attributes":[{{"key":"region","value":{{"stringValue":"eu"}}}},{{"key":"service.name","value":{{"stringValue":"' || service || '"}}}}],"status":{{"code":' || CASE WHEN error THEN 2 ELSE 1 END || '}}}}' AS json FROM s""")
def otlp_spans(spark, sf_dir):
    c, hexed = F.col, lambda x, n: F.lower(F.lpad(F.hex(F.col(x).cast("long")), n, "0"))
    tags = F.create_map(F.lit("span.kind"), F.lit("server"), F.lit("error"), c("error").cast("string"), F.lit("region"), F.lit("eu"))
    s = {"trace_id": hexed("trace_id", 32), "span_id": hexed("span_id", 16), "parent_id": hexed("parent_span_id", 16), "name": c("operation"), "start_us": c("start_us"), "end_us": c("end_us"), "service": c("service"), "tags": tags}
    return spans(spark, sf_dir).select("trace_id", "span_id", E.otlp_span(s).alias("json"))


@query(f"""WITH {SPANS} SELECT operation, start_us, end_us - start_us AS duration_us, '[{{"key":"service","vType":"string","vStr":"' || service || '"}}]' AS tags, count(*) AS spans FROM s GROUP BY ALL""")
def jaeger_fields(spark, sf_dir):
    c = F.col
    s = {"trace_id": c("trace_id").cast("string"), "span_id": c("span_id").cast("string"), "parent_id": c("parent_span_id").cast("string"), "name": c("operation"), "start_us": c("start_us"), "duration_us": c("end_us") - c("start_us"), "tags": F.create_map(F.lit("service"), c("service"))}
    j = spans(spark, sf_dir).select(E.jaeger_span(s).alias("json"))
    field = lambda path: F.get_json_object("json", path)
    return j.groupBy(field("$.operationName").alias("operation"), field("$.startTime").cast("long").alias("start_us"), field("$.duration").cast("long").alias("duration_us"), field("$.tags").alias("tags")).agg(F.count("*").alias("spans"))


@query("""WITH {m}, l AS (SELECT 'influx' AS form, name || ',k=' || k || ',user_id=' || user_id || ' value=' || row_id || ' ' || (us * 1000) AS text FROM m UNION ALL SELECT 'statsd', name || ':' || row_id || '|g|#k:' || k || ',user_id:' || user_id FROM m) SELECT * FROM l""")
def exported_forms(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("value", F.col("row_id"))
    parts = [E.exported(m, form).select(F.lit(form).alias("form"), "text") for form in ("influx", "statsd")]
    return parts[0].union(parts[1])
