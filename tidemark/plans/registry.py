"""All queries of the metrics engine over the driver's tables, each with its DuckDB statement where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.folders import shared_root
from ..functions.times import micros
from ..operators import aggregates as A
from ..operators import alerts as AL
from ..operators import buffers, derived, folds, graphs, ordering, scans
from ..operators import series as S
from ..operators import triggers as T
from ..sources import encoders as E
from ..sources import collectors, storage
from ..streaming import jobs, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY, HOUR, MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01
METRICS = "m AS (SELECT event_type AS name, epoch_us(ts) AS us, value, event_id AS row_id, user_id, coalesce(json_extract_string(props, '$.k'), '') AS k, 1 AS n FROM events)"


def query(sql: str | None = None):
    """Registers a query under its name, with its statement if it has one; ``{m}`` stands for the metrics rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{m}", METRICS)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_frame(read(spark, sf_dir, "events"))


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as traces: a line's parent is the line before it; its duration is its quantity in milliseconds."""
    start = micros(F.col("l_shipdate"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent_span_id"),
        F.col("l_returnflag").alias("operation"), F.col("l_linestatus").alias("service"), start.alias("start_us"), (start + (F.col("l_quantity") * 1000).cast("long")).alias("end_us"), (F.col("l_returnflag") == "R").alias("error"))


SPANS = """s AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS parent_span_id, l_returnflag AS operation,
  l_linestatus AS service, epoch_us(l_shipdate) AS start_us, epoch_us(l_shipdate) + (l_quantity * 1000)::BIGINT AS end_us, l_returnflag = 'R' AS error FROM lineitem)"""


# --- series ---------------------------------------------------------------------------------------------------------

RANGE_SQL = f"""SELECT name, {T0 + 7 * HOUR} + ((us - {T0 + 7 * HOUR}) // {6 * HOUR}) * {6 * HOUR} AS step_start, max(us) AS ts, round(sum(value * n) / sum(n), 6) AS value, sum(n)::BIGINT AS sample_count
FROM m WHERE us >= {T0 + 7 * HOUR} AND us < {T0 + 25 * DAY} GROUP BY ALL"""


@query("WITH {m} " + RANGE_SQL)
def range_query(spark, sf_dir):
    return rounded(S.range_query(metrics(spark, sf_dir), T0 + 7 * HOUR, T0 + 25 * DAY, 6 * HOUR), "value")


@query(f"""WITH s AS (SELECT l_returnflag AS name, epoch_us(l_shipdate) AS us, l_extendedprice AS value, l_quantity::INT AS n FROM lineitem WHERE l_returnflag IN ('A', 'R')),
b AS (SELECT min(us) AS lo FROM s) SELECT name, 694224000000000 + ((us - 694224000000000) // {30 * DAY}) * {30 * DAY} AS step_start, max(us) AS ts, round(sum(value * n) / sum(n), 4) AS value, sum(n)::BIGINT AS sample_count
FROM s WHERE us >= 694224000000000 AND us < 2000000000000000 GROUP BY ALL""")
def range_query_weighted(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), micros(F.col("l_shipdate")).alias("us"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").cast("int").alias("n"))
    return rounded(S.range_query(s, 694_224_000_000_000, 2_000_000_000_000_000, 30 * DAY, ["A", "R"]), "value", digits=4)


@query(f"""WITH {{m}}, p AS (SELECT name, (us - {T0}) // {DAY} AS step, max(us) AS ts, sum(value * n) / sum(n) AS value, sum(n) AS sample_count FROM m WHERE us >= {T0} AND us < {T0 + 30 * DAY} GROUP BY ALL)
SELECT name, count(*) AS steps, sum(sample_count)::BIGINT AS total_samples, round(sum(value * sample_count) / sum(sample_count), 6) AS average, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
  round((arg_max(value, ts) - arg_min(value, ts)) / ((max(ts) - min(ts)) // 1000000) * 1e6, 4) AS rate_per_million_s FROM p GROUP BY name""")
def range_summary(spark, sf_dir):
    df = S.range_summary(S.range_query(metrics(spark, sf_dir), T0, T0 + 30 * DAY, DAY))
    return rounded(df.withColumn("rate_per_million_s", F.round(F.col("rate") * 1e6, 4)).drop("rate"), "average", "min_value", "max_value")


@query(f"""WITH {{m}}, p AS (SELECT name, {T0} + ((us - {T0}) // {HOUR}) * {HOUR} AS step_start, max(us) AS ts, round(avg(value), 6) AS value, count(*) AS sample_count FROM m WHERE us >= {T0} AND us < {T0 + 30 * DAY} GROUP BY ALL),
g AS (SELECT n.name, unnest(range({T0}, {T0 + 30 * DAY}, {HOUR})) AS step_start FROM (SELECT DISTINCT name FROM p) n)
SELECT name, step_start, ts, value, coalesce(sample_count, 0)::BIGINT AS sample_count FROM g LEFT JOIN p USING (name, step_start)""")
def gap_filled_range(spark, sf_dir):
    return rounded(S.gap_filled(S.range_query(metrics(spark, sf_dir), T0, T0 + 30 * DAY, HOUR), T0, T0 + 30 * DAY, HOUR), "value")


@query("WITH {m} SELECT name, count(*) AS points, min(us) AS first_us, max(us) AS last_us, arg_max(value, (us, row_id)) AS latest, 'k,user_id' AS label_keys FROM m GROUP BY name")
def series_catalogue(spark, sf_dir):
    return S.catalogue(metrics(spark, sf_dir))


@query("WITH {m}, r AS (SELECT name, us, value, row_id, row_number() OVER (PARTITION BY name ORDER BY us DESC, row_id DESC) AS rank FROM m) SELECT * FROM r WHERE rank <= 100")
def ring_buffer(spark, sf_dir):
    return S.newest(metrics(spark, sf_dir).select("name", "us", "value", "row_id"), ["name"], ["us", "row_id"], 100)


@query("WITH {m} SELECT user_id, arg_max(value, (us, row_id)) AS value FROM m GROUP BY user_id")
def key_value_store(spark, sf_dir):
    df = metrics(spark, sf_dir).withColumn("user_id", F.col("tags")["user_id"].cast("long"))
    return S.last_write(df, "user_id", ["us", "row_id"], "value")


@query(f"WITH {{m}} SELECT name, row_id, us FROM m WHERE us >= {T0 + 25 * DAY}")
def retention(spark, sf_dir):
    return S.retained(metrics(spark, sf_dir), T0 + 30 * DAY, 5 * DAY).select("name", "row_id", "us")


@query(f"""WITH x AS (SELECT user_id::VARCHAR AS name, epoch_us(ts) AS us, event_id AS row_id FROM events), a AS (SELECT name FROM x GROUP BY name HAVING max(us) >= {T0 + 28 * DAY})
SELECT name, count(*) AS points FROM x WHERE name IN (SELECT name FROM a) GROUP BY name""")
def idle_eviction(spark, sf_dir):
    df = metrics(spark, sf_dir).withColumn("name", F.col("tags")["user_id"])
    return S.retained(df, T0 + 30 * DAY, 2 * DAY, idle=True).groupBy("name").agg(F.count("*").alias("points"))


@query("""WITH {m}, w AS (SELECT *, lag(us) OVER o AS b, lead(us) OVER o AS a, lag(value) OVER o AS vb, lead(value) OVER o AS va FROM m WINDOW o AS (PARTITION BY name ORDER BY us, row_id))
SELECT name, us, row_id, value FROM w WHERE b IS NULL OR a IS NULL OR abs(value - (vb + (va - vb) * CASE WHEN a <> b THEN (us - b) / (a - b) ELSE 0 END)) > 20""")
def compression(spark, sf_dir):
    return S.compressed(metrics(spark, sf_dir), 20.0, ["us", "row_id"]).select("name", "us", "row_id", "value")


@query("""WITH {m}, f AS (SELECT name, min((us, row_id)) AS seen FROM m GROUP BY name ORDER BY seen, name LIMIT 3) SELECT name, count(*) AS points FROM m WHERE name IN (SELECT name FROM f) GROUP BY name""")
def capped_series(spark, sf_dir):
    return storage.capped_series(metrics(spark, sf_dir), 3).groupBy("name").agg(F.count("*").alias("points"))


@query(f"""WITH {{m}}, x AS (SELECT name, us // {DAY} AS day, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY name ORDER BY day DESC) AS r FROM x),
k AS (SELECT *, dense_rank() OVER (PARTITION BY name ORDER BY day) - 1 AS snapshot FROM r WHERE r <= 10) SELECT name, day, n, total, snapshot FROM k WHERE snapshot BETWEEN 2 AND 5""")
def snapshot_range(spark, sf_dir):
    daily = metrics(spark, sf_dir).groupBy("name", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return storage.snapshot_range(storage.snapshots(daily, "name", "day", 10), 2, 4)


@query("""WITH {m}, w AS (SELECT *, (us - lag(us) OVER o) / 1e6 AS dt, lag(value) OVER o AS p FROM m WINDOW o AS (PARTITION BY name ORDER BY us, row_id))
SELECT name, round(arg_max(value, (us, row_id)) - arg_min(value, (us, row_id)), 6) AS delta, round((arg_max(value, (us, row_id)) - arg_min(value, (us, row_id))) / ((max(us) - min(us)) / 1e6) * 1e6, 4) AS rate_per_million_s,
  round(avg(CASE WHEN dt > 0 THEN (value - p) / dt END), 4) AS derivative, round(sum((value + p) / 2 * dt), 0) AS integral FROM w GROUP BY name""")
def series_calculus(spark, sf_dir):
    c = S.calculus(metrics(spark, sf_dir), ["us", "row_id"])
    return c.select("name", r6(F.col("delta"), "delta"), F.round(F.col("rate") * 1e6, 4).alias("rate_per_million_s"), F.round("derivative", 4).alias("derivative"), F.round("integral", 0).alias("integral"))


@query("""WITH {m}, w AS (SELECT *, (us - lag(us) OVER o) / 1e6 AS dt, lag(value) OVER o AS p FROM m WINDOW o AS (PARTITION BY name ORDER BY us, row_id))
SELECT name, row_id, round(CASE WHEN p > 0 AND value >= p AND dt > 0 THEN (value - p) / dt END, 6) AS rate FROM w""")
def counter_rates(spark, sf_dir):
    return S.counter_rates(metrics(spark, sf_dir), ["us", "row_id"]).select("name", "row_id", r6(F.col("rate"), "rate"))


@query("""WITH c AS (SELECT l_returnflag AS name, l_orderkey * 10 + l_linenumber AS seq, sum(l_quantity) OVER w AS total, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) OVER w AS idle FROM lineitem
  WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), d AS (SELECT name, seq, total - lag(total) OVER o AS dt, idle - lag(idle) OVER o AS di FROM c WINDOW o AS (PARTITION BY name ORDER BY seq))
SELECT name, count(*) AS rows, round(avg(CASE WHEN dt > 0 THEN 100 * (1 - di / dt) ELSE 0 END), 6) AS mean_busy FROM d GROUP BY name""")
def cpu_percent(spark, sf_dir):
    seq, wide = F.col("l_orderkey") * 10 + F.col("l_linenumber"), 1_000_000
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), seq.alias("seq"), "l_quantity", "l_linestatus")
    idle = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)
    c = scans.running_sums(lines, ["name"], ["seq"], {"total": F.col("l_quantity"), "idle": idle}, wide)
    return S.busy_percent(c, "idle", "total", "name", ["seq"], wide).groupBy("name").agg(F.count("*").alias("rows"), r6(F.avg("busy"), "mean_busy"))


@query(f"""WITH {{m}}, x AS (SELECT us // {HOUR} AS h, avg(value) AS x FROM m WHERE name = 'click' GROUP BY 1), y AS (SELECT us // {HOUR} AS h, avg(value) AS y FROM m WHERE name = 'view' GROUP BY 1)
SELECT count(*) AS steps, round(coalesce(corr(x, y), 0), 6) AS r FROM x JOIN y USING (h)""")
def correlation(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return rounded(S.correlation(m.where("name = 'click'"), m.where("name = 'view'"), 0, HOUR), "r")


@query("""WITH {m}, a AS (SELECT user_id, us, row_id AS id FROM m WHERE name = 'purchase'), b AS (SELECT user_id, us, max(value) AS value FROM m WHERE name = 'view' GROUP BY ALL)
SELECT a.user_id, a.us, a.id, b.value AS as_of FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.us""")
def as_of_join(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("user_id", F.col("tags")["user_id"].cast("long"))
    return S.as_of_join(m.where("name = 'purchase'").select("user_id", "us", F.col("row_id").alias("id")), m.where("name = 'view'").select("user_id", "us", "value"), "user_id", "value")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("""WITH {m} SELECT name, count(value) AS count, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 6) AS std_dev, min(value) AS min_value, max(value) AS max_value, round(sum(value), 4) AS sum,
  round(stddev_samp(value) / abs(avg(value)), 6) AS cv, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
  round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3, 4) AS skewness, round(kurtosis_pop(value) + 3, 4) AS kurtosis, round(count(*) / ((max(us) - min(us)) / 1e6), 6) AS rate_per_second FROM m GROUP BY name""")
def stream_stats(spark, sf_dir):
    df = S.load_frame(read(spark, sf_dir, "events"))
    df = rounded(A.stream_stats(df, ["name"]), "mean", "std_dev", "cv", "rate_per_second", "iqr")
    return rounded(df, "variance", "sum", "skewness", "kurtosis", digits=4).withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


ORACLE_SQL["stream_stats"] = ORACLE_SQL["stream_stats"].replace("quantile_cont(value, 0.25) AS q1", "round(quantile_cont(value, 0.25), 9) AS q1").replace("quantile_cont(value, 0.5) AS median", "round(quantile_cont(value, 0.5), 9) AS median").replace("quantile_cont(value, 0.75) AS q3", "round(quantile_cont(value, 0.75), 9) AS q3")


@query("WITH {m} SELECT name, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p99_9, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev FROM m GROUP BY name")
def timer_snapshot(spark, sf_dir):
    return rounded(A.timer(metrics(spark, sf_dir), ["name"], "value"), "p50", "p90", "p95", "p99", "p99_9", "mean", "std_dev")


@query("""WITH o AS (SELECT o_orderpriority AS operation, (o_totalprice * 1000)::BIGINT AS d FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY operation) AS n FROM o)
SELECT operation, max(d) FILTER (WHERE i = floor(0.5::DOUBLE * (n - 1) + 0.5)) AS p50, max(d) FILTER (WHERE i = floor(0.95::DOUBLE * (n - 1) + 0.5)) AS p95, max(d) FILTER (WHERE i = floor(0.99::DOUBLE * (n - 1) + 0.5)) AS p99 FROM r GROUP BY operation""")
def duration_percentiles(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("operation"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("d"))
    return A.nearest_rank(o, ["operation"], "d", (0.5, 0.95, 0.99))


HISTOGRAM = ", ".join(f"{{le: '{'+Inf' if b == float('inf') else f'{b:g}'}', n: count(*) FILTER (WHERE value / 100 <= {'1e308' if b == float('inf') else b})}}" for b in A.STANDARD_BOUNDS)


@query("WITH {m}, h AS (SELECT name, count(*) AS count, round(sum(value / 100), 6) AS sum, unnest([" + HISTOGRAM + "]) AS b FROM m GROUP BY name) SELECT name, count, sum, b.le AS le, b.n AS bucket_count FROM h")
def histogram(spark, sf_dir):
    return rounded(A.histogram(metrics(spark, sf_dir).withColumn("value", F.col("value") / 100), ["name"]), "sum")


@query("WITH {m} SELECT name, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std_dev, min(value) AS min_value, max(value) AS max_value, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(us) AS oldest_us, max(us) AS newest_us FROM m GROUP BY name")
def buffer_statistics(spark, sf_dir):
    return rounded(rounded(A.summary(metrics(spark, sf_dir), ["name"], us="us"), "mean", "median", "std_dev", "p95", "p99"), "total", digits=4)


@query("""WITH o AS (SELECT o_orderpriority AS operation, round(o_totalprice * 1000)::BIGINT AS d, o_orderstatus <> 'F' AS ok, epoch_us(o_orderdate) AS us FROM orders)
SELECT operation, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors, sum(d)::BIGINT AS total_ns, min(d) AS min_ns, max(d) AS max_ns, (sum(d) // count(*))::BIGINT AS mean_ns, round(avg(ok::INT), 6) AS success_rate, round(count(*) / ((max(us) - min(us)) / 1e6) * 1e6, 4) AS per_million_s FROM o GROUP BY operation""")
def operation_profile(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("operation"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("d"), (F.col("o_orderstatus") != "F").alias("ok"), micros(F.col("o_orderdate")).alias("us"))
    p = A.profile(o, "operation", "d", "ok", "us")
    return rounded(p.withColumn("per_million_s", F.round(F.col("throughput") * 1e6, 4)).drop("throughput"), "success_rate")


@query("""WITH {m}, t AS (SELECT *, name || ';k=' || k AS key, CASE WHEN name IN ('click', 'view') THEN 'counter' ELSE 'gauge' END AS type FROM m)
SELECT key, type, round(CASE WHEN type = 'counter' THEN sum(value) ELSE arg_max(value, (us, row_id)) END, 6) AS value, count(*) AS points FROM t GROUP BY key, type""")
def tagged_metrics(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("type", F.when(F.col("name").isin("click", "view"), "counter").otherwise("gauge"))
    m = m.withColumn("tags", F.map_filter("tags", lambda k, _: k == "k"))
    return rounded(A.tagged(m, L.metric_key(F.col("name"), F.col("tags")), F.col("type"), ["us", "row_id"]), "value")


RULES = (("click", "ui.click"), ("error", "api.error"), ("purchase", "shop.purchase"))


@query(f"""WITH {{m}}, r(source_metric, prefix) AS (VALUES {', '.join(map(str, RULES))}), w AS (SELECT prefix, us // {DAY} * {DAY} AS window_start, avg(value) AS mean, min(value) AS min, max(value) AS max, coalesce(stddev_samp(value), 0) AS stddev, count(*)::DOUBLE AS count, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM m JOIN r ON name = source_metric GROUP BY ALL),
u AS (UNPIVOT w ON mean, min, max, stddev, count, p50, p95 INTO NAME k VALUE value) SELECT prefix || '.' || k AS metric, window_start, round(value, 6) AS value FROM u""")
def rule_aggregation(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "source_metric string, prefix string")
    return rounded(A.rule_outputs(metrics(spark, sf_dir), rules, DAY), "value")


@query("SELECT event_type AS name, count(DISTINCT user_id) AS unique_values FROM events GROUP BY 1")
def unique_values(spark, sf_dir):
    return A.unique_values(metrics(spark, sf_dir).withColumn("user", F.col("tags")["user_id"]), ["name"], "user")


@query("WITH {m} SELECT DISTINCT name, k FROM m")
def label_values(spark, sf_dir):
    return metrics(spark, sf_dir).select("name", F.col("tags")["k"].alias("k")).distinct()


@query(f"""WITH {{m}} SELECT name, k, us // {DAY} * {DAY} AS time, round(sum(value), 4) AS sum, count(*) AS count FROM m WHERE name IN ('error', 'signup') AND us >= {T0} AND us < {T0 + 10 * DAY} AND value > 10 GROUP BY ALL ORDER BY sum DESC, name, k, time LIMIT 50""")
def metric_query(spark, sf_dir):
    return A.metric_query(
        metrics(spark, sf_dir), ["error", "signup"], F.col("value") > 10, T0, T0 + 10 * DAY, ("k",), DAY, {"sum": F.round(F.sum("value"), 4), "count": F.count("*")},
        [F.desc("sum"), F.col("name"), F.col("k"), F.col("time")], 50)


@query("WITH {m} SELECT name, row_id, round(value + 1, 6) AS add, round(value / CASE WHEN row_id % 3 = 0 THEN NULL ELSE row_id % 3 END, 6) AS div, round(power(value, 2), 4) AS pow, round(abs(-value), 6) AS abs FROM m WHERE name IN ('error') OR contains(name, 'ick')")
def expressions(spark, sf_dir):
    m = metrics(spark, sf_dir).where((F.col("name") == "error") | F.contains("name", F.lit("ick")))
    return m.select("name", "row_id", r6(F.col("value") + 1, "add"), F.round(F.try_divide("value", F.col("row_id") % 3), 6).alias("div"), F.round(F.pow("value", F.lit(2)), 4).alias("pow"), r6(F.abs(-F.col("value")), "abs"))


# --- windows and triggers -------------------------------------------------------------------------------------------


@query(f"""WITH {{m}} SELECT name, row_id, count(value) OVER o AS m_count, round(sum(value) OVER o, 4) AS m_sum, round(avg(value) OVER o, 6) AS m_mean, min(value) OVER o AS m_min, max(value) OVER o AS m_max,
  round(CASE WHEN (max(us) OVER o - min(us) OVER o) // 1000000 > 0 THEN count(value) OVER o / ((max(us) OVER o - min(us) OVER o) // 1000000) ELSE 0 END, 9) AS m_rate FROM m WINDOW o AS (PARTITION BY name ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW)""")
def moving_window(spark, sf_dir):
    df = T.moving(metrics(spark, sf_dir).drop("tags"), "name", HOUR).select("name", "row_id", "m_count", "m_sum", "m_mean", "m_min", "m_max", "m_rate")
    return rounded(rounded(rounded(df, "m_mean"), "m_sum", digits=4), "m_rate", digits=9)


@query("""WITH {m}, z AS (SELECT name, row_id, count(value) OVER o > 10 AND abs(value - avg(value) OVER o) / (stddev_samp(value) OVER o + 1e-10) > 3 AS outlier FROM m
WINDOW o AS (PARTITION BY name ORDER BY us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT name, row_id, coalesce(outlier, false) AS outlier FROM z""")
def outliers(spark, sf_dir):
    return T.outliers(metrics(spark, sf_dir), "name", ["us", "row_id"]).select("name", "row_id", "outlier")


@query("""WITH {m}, z AS (SELECT name, row_id, count(value) OVER o >= 10 AND stddev_samp(value) OVER o >= 1e-10 AND abs(value - avg(value) OVER o) / stddev_samp(value) OVER o > 3 AS anomaly FROM m
WINDOW o AS (PARTITION BY name ORDER BY us, row_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT name, row_id, coalesce(anomaly, false) AS anomaly FROM z""")
def anomaly_trigger(spark, sf_dir):
    return T.anomalies(metrics(spark, sf_dir), "name", ["us", "row_id"]).select("name", "row_id", "anomaly")


@query("WITH {m} SELECT name, row_id, coalesce(abs(value - lag(value) OVER (PARTITION BY name ORDER BY us, row_id)) > 150, false) AS delta FROM m")
def delta_trigger(spark, sf_dir):
    return T.deltas(metrics(spark, sf_dir), "name", ["us", "row_id"], 150.0).select("name", "row_id", "delta")


@query(f"WITH {{m}}, g AS (SELECT name, row_id, us - lag(us) OVER (PARTITION BY name ORDER BY us, row_id) AS gap_us FROM m) SELECT name, row_id, gap_us, coalesce(gap_us > {40 * MINUTE}, false) AS absent FROM g")
def absent_trigger(spark, sf_dir):
    return T.absences(metrics(spark, sf_dir), "name", ["us", "row_id"], 40 * MINUTE).select("name", "row_id", "gap_us", "absent")


@query(f"""WITH {{m}}, c AS (SELECT name, row_id, CASE WHEN count(value) OVER o >= 2 AND var_pop(us / 1000.0) OVER o > 1e-10 THEN covar_pop(us / 1000.0, value) OVER o / var_pop(us / 1000.0) OVER o ELSE 0 END * {6 * HOUR / 1000} AS change FROM m
WINDOW o AS (PARTITION BY name ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)) SELECT name, row_id, round(change, 6) > 100 AS fast FROM c""")
def rate_of_change_trigger(spark, sf_dir):
    df = T.slopes(metrics(spark, sf_dir).drop("tags"), "name", 6 * HOUR, 100.0, "increasing")
    return df.select("name", "row_id", (F.round("change", 6) > 100).alias("fast"))


@query("""WITH RECURSIVE {m}, e AS (SELECT name, row_id, value, row_number() OVER (PARTITION BY name ORDER BY us, row_id) AS rn FROM m),
s AS (SELECT name, rn, row_id, value AS smoothed FROM e WHERE rn = 1 UNION ALL SELECT e.name, e.rn, e.row_id, 0.7::DOUBLE * e.value + (1 - 0.7::DOUBLE) * s.smoothed FROM s JOIN e ON e.name = s.name AND e.rn = s.rn + 1)
SELECT name, row_id, round(smoothed, 6) AS smoothed FROM s""")
def smoothing(spark, sf_dir):
    return rounded(S.smoothed(metrics(spark, sf_dir), "name", ["us", "row_id"], 0.7, DAY), "smoothed").select("name", "row_id", "smoothed")


@query("""WITH e AS (SELECT event_id AS row_id, least(100, value) AS cpu, least(100, event_id % 101) AS memory FROM events),
p AS (SELECT *, greatest(cpu, CASE WHEN memory > 85 THEN 81 WHEN memory > 70 THEN 61 ELSE 0 END) AS load FROM e)
SELECT row_id, CASE WHEN load >= 80 THEN 'critical' WHEN load >= 60 THEN 'high' WHEN load >= 40 THEN 'moderate' WHEN load >= 20 THEN 'low' ELSE 'idle' END AS level, CASE WHEN cpu >= 90 THEN 2 WHEN cpu >= 75 THEN 1 ELSE 0 END AS state FROM p""")
def load_levels(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.least(F.lit(100.0), "value").alias("cpu"), (F.col("event_id") % 101).alias("memory"))
    return e.select("row_id", T.load_level(T.pressure(F.col("cpu"), F.col("memory"))).alias("level"), T.threshold_state(F.col("cpu"), 75, 90).alias("state"))


@query(f"""WITH {{m}}, c AS (SELECT name, us // {HOUR} AS hour, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT *, avg(n) OVER (PARTITION BY name ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS baseline FROM c)
SELECT name, hour, n, round(baseline, 6) AS baseline, CASE WHEN n > 2 * baseline THEN 'spike' WHEN n < 0.1 * baseline THEN 'drop' ELSE 'normal' END AS state FROM b""")
def log_baseline(spark, sf_dir):
    c = metrics(spark, sf_dir).groupBy("name", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    return rounded(T.log_baseline(c, "name", "hour", "n"), "baseline")


@query("""WITH {m} SELECT name, row_id, CASE WHEN count(value) OVER o >= 3 AND min(value) OVER o > 60 THEN 'up' WHEN count(value) OVER o >= 3 AND max(value) OVER o < 20 THEN 'down' ELSE 'hold' END AS decision FROM m
WINDOW o AS (PARTITION BY name ORDER BY us, row_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def scaling_decision(spark, sf_dir):
    return T.scaling(metrics(spark, sf_dir), "name", ["us", "row_id"], 60.0, 20.0).select("name", "row_id", "decision")


@query("WITH {m} SELECT row_id, (value > 80 OR value < 20) AS any_of, ((value > 30)::INT + (value < 60)::INT = 1) AS one_of, NOT (value > 80) AS none_of, (value BETWEEN 20 AND 40 AND contains(name, 'i')) AS nested FROM m")
def composite_triggers(spark, sf_dir):
    v = F.col("value")
    nested = T.condition({"all": [{"not": {"field": "value", "op": "<", "value": 20}}, {"not": {"field": "value", "op": ">", "value": 40}}, {"field": "name", "op": "contains", "value": "i"}]})
    return metrics(spark, sf_dir).select(
        "row_id", T.combined("or", [T.compared(v, ">", 80), T.compared(v, "<", 20)]).alias("any_of"), T.combined("xor", [T.compared(v, ">", 30), T.compared(v, "<", 60)]).alias("one_of"),
        T.combined("not", [T.compared(v, ">", 80)]).alias("none_of"), nested.alias("nested"))


def adaptive_levels(spark, sf_dir):
    e = metrics(spark, sf_dir).withColumns({"cpu": F.least(F.lit(100.0), "value"), "memory": F.col("row_id") % 101, "us": F.col("us") * 1})
    return folds.adaptive_levels(e, "name", margin=5.0, cooldown_us=HOUR)


QUERIES["adaptive_levels"] = adaptive_levels


# --- alerts ---------------------------------------------------------------------------------------------------------

ALERT_RULES = (("slow_click", "click", ">", 150.0, "warning", True), ("big_error", "error", ">=", 100.0, "critical", True), ("low_view", "view", "<", 1.0, "info", True), ("off", "signup", ">", 0.0, "info", False))


@query(f"""WITH {{m}}, r(rule, metric, op, threshold, severity, enabled) AS (VALUES {', '.join(str(r).replace('True', 'true').replace('False', 'false') for r in ALERT_RULES)})
SELECT rule, severity, row_id, value FROM m JOIN r ON name = metric WHERE enabled AND CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold ELSE value >= threshold END""")
def threshold_alerts(spark, sf_dir):
    rules = spark.createDataFrame(ALERT_RULES, "rule string, metric string, op string, threshold double, severity string, enabled boolean")
    return AL.threshold_alerts(metrics(spark, sf_dir), rules).select("rule", "severity", "row_id", "value")


def states_sql(key: str, value: str = "name", above: float = 60) -> str:
    """The state machine as a recursive statement: tables ``e`` (evaluations) and ``s`` (their states) by ``key``, an expression ``value``."""
    return f"""WITH RECURSIVE {{m}}, e AS (SELECT {value} AS {key}, us, value, value > {above} AS met, row_number() OVER (PARTITION BY {value} ORDER BY us, row_id) AS rn FROM m),
s AS (SELECT {key}, rn, us, CASE WHEN met THEN 'pending' ELSE 'inactive' END AS state, us AS since FROM e WHERE rn = 1
UNION ALL SELECT e.{key}, e.rn, e.us, CASE WHEN e.met AND s.state IN ('inactive', 'resolved') THEN 'pending' WHEN e.met AND s.state = 'pending' AND e.us - s.since >= {10 * MINUTE} THEN 'firing'
  WHEN NOT e.met AND s.state = 'firing' THEN 'resolved' WHEN NOT e.met AND s.state = 'pending' THEN 'inactive' ELSE s.state END,
  CASE WHEN e.met AND s.state IN ('inactive', 'resolved') THEN e.us ELSE s.since END FROM s JOIN e ON e.{key} = s.{key} AND e.rn = s.rn + 1)"""


STATES_SQL = states_sql("name")


def evaluated(spark, sf_dir) -> DataFrame:
    m = metrics(spark, sf_dir).withColumn("met", F.col("value") > 60)
    return AL.states(m, ["name"], ["us", "row_id"], "met", 10 * MINUTE)


@query(STATES_SQL + " SELECT name, state, count(*) AS rows, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY ALL")
def alert_states(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("name", "state").agg(F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(STATES_SQL + ", c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY name ORDER BY rn), 'inactive') AS before FROM s) SELECT name, count(*) FILTER (WHERE state = 'pending') AS created, count(*) FILTER (WHERE state = 'firing') AS fired, count(*) FILTER (WHERE state = 'resolved') AS resolved FROM c WHERE state <> before GROUP BY name")
def alert_counters(spark, sf_dir):
    return AL.counters(AL.transitions(evaluated(spark, sf_dir), ["name"], ["us", "row_id"]), ["name"])


def alerts(spark, sf_dir) -> DataFrame:
    """Events over 100 as firing alerts with labels k and user, severity by value."""
    m = metrics(spark, sf_dir).where("value > 100")
    severity = F.when(F.col("value") > 250, "critical").when(F.col("value") > 150, "warning").otherwise("info")
    a = m.select("name", "us", "value", F.col("row_id").alias("id"), F.col("tags").alias("labels"), severity.alias("severity"), F.lit("firing").alias("state"))
    return a.withColumn("fingerprint", L.fingerprint(F.col("name"), F.col("labels")))


ALERTS = "a AS (SELECT name, us, value, row_id AS id, user_id, k, CASE WHEN value > 250 THEN 'critical' WHEN value > 150 THEN 'warning' ELSE 'info' END AS severity, name || '{k=' || k || ',user_id=' || user_id || ',}' AS fingerprint FROM m WHERE value > 100)"


@query(f"""WITH {{m}}, {ALERTS} SELECT id FROM a WHERE NOT ((k = '7' AND us >= {T0} AND us < {T0 + 20 * DAY}) OR (k = '9' AND us >= {T0 + DAY} AND us < {T0 + 9 * DAY}))""")
def silences(spark, sf_dir):
    rows = [({"k": "7"}, T0, T0 + 20 * DAY), ({"k": "9", "zone": ""}, T0 + DAY, T0 + 9 * DAY)]
    s = spark.createDataFrame(rows, "matchers map<string,string>, starts_us long, ends_us long")
    return AL.silenced(alerts(spark, sf_dir), s).select("id")


@query(f"""WITH {{m}}, {ALERTS} SELECT id FROM a t WHERE NOT (severity = 'info' AND EXISTS (SELECT 1 FROM a s WHERE s.severity = 'critical' AND s.k = t.k AND s.fingerprint <> t.fingerprint))""")
def inhibition(spark, sf_dir):
    return AL.inhibited(alerts(spark, sf_dir), F.col("severity") == "critical", F.col("severity") == "info", ["k"]).select("id")


@query(f"""WITH {{m}}, {ALERTS} SELECT CASE WHEN severity = 'critical' THEN 'pager' WHEN name = 'error' THEN 'api-team' WHEN name LIKE '%i%' THEN 'web-team' ELSE 'default' END AS receiver, severity, count(*) AS alerts FROM a GROUP BY ALL""")
def routing(spark, sf_dir):
    routes = [(F.col("severity") == "critical", "pager"), (F.col("name") == "error", "api-team"), (F.col("name").like("%i%"), "web-team")]
    return AL.routed(alerts(spark, sf_dir), routes, "default").groupBy("receiver", "severity").agg(F.count("*").alias("alerts"))


@query(f"""WITH {{m}}, {ALERTS} SELECT name || ':' || k || '::' AS group_key, count(*) AS size, ['info', 'warning', 'critical'][max(CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END)] AS max_severity, min(us) AS first_us, max(us) AS last_us FROM a GROUP BY 1""")
def alert_groups(spark, sf_dir):
    return AL.grouped(alerts(spark, sf_dir), L.group_key(F.col("name"), F.col("labels"), ["k", "zone"]))


DEDUP_SQL = """WITH {m}, x AS (SELECT name || ';' || k AS key, row_id, us, CASE WHEN value > 60 THEN 'firing' ELSE 'resolved' END AS state FROM m), l AS (SELECT *, lag(state) OVER o AS before, row_number() OVER o AS rn FROM x WINDOW o AS (PARTITION BY key ORDER BY us, row_id))
SELECT key, row_id, state FROM l WHERE """


def sightings(spark, sf_dir) -> DataFrame:
    m = metrics(spark, sf_dir)
    return m.select(F.concat("name", F.lit(";"), F.col("tags")["k"]).alias("key"), "row_id", "us", F.when(F.col("value") > 60, "firing").otherwise("resolved").alias("state"))


@query(DEDUP_SQL + "before IS NULL OR state <> before")
def dedup_strict(spark, sf_dir):
    return AL.deduplicated(sightings(spark, sf_dir), ["key"], ["us", "row_id"]).select("key", "row_id", "state")


@query(DEDUP_SQL + "rn <= 2 OR state <> before")
def dedup_compatible(spark, sf_dir):
    return AL.deduplicated(sightings(spark, sf_dir), ["key"], ["us", "row_id"], compat=True).select("key", "row_id", "state")


@query(f"""WITH RECURSIVE {{m}}, e AS (SELECT k, us, row_id, row_number() OVER (PARTITION BY k ORDER BY us, row_id) AS rn FROM m WHERE value > 60),
c AS (SELECT k, rn, row_id, us AS last, true AS pass FROM e WHERE rn = 1 UNION ALL SELECT e.k, e.rn, e.row_id, CASE WHEN e.us - c.last >= {2 * HOUR} THEN e.us ELSE c.last END, e.us - c.last >= {2 * HOUR} FROM c JOIN e ON e.k = c.k AND e.rn = c.rn + 1)
SELECT k, row_id FROM c WHERE pass""")
def cooldown(spark, sf_dir):
    m = metrics(spark, sf_dir).where("value > 60").select(F.col("tags")["k"].alias("k"), "us", "row_id").orderBy("us", "row_id")
    return AL.cooled(m, ["k"], 2 * HOUR).select("k", "row_id")


@query(f"""WITH {{m}}, {ALERTS}, f AS (SELECT name, id, us, fingerprint AS text FROM a),
p AS (SELECT a.id AS a, b.id AS b, 1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text), 1) AS similarity FROM f a JOIN f b ON a.name = b.name AND b.us >= a.us AND b.us - a.us <= {10 * DAY} AND (b.us > a.us OR b.id > a.id))
SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.85""")
def similar_alerts(spark, sf_dir):
    return AL.similar_alerts(alerts(spark, sf_dir).withColumnRenamed("fingerprint", "text"), 10 * DAY, digits=6)


@query(f"""WITH {{m}}, {ALERTS}, p AS (SELECT a.id AS a, b.id AS b, a.fingerprint AS x, b.fingerprint AS y, CASE WHEN a.k = b.k AND a.user_id = b.user_id THEN 1.0 WHEN a.k = b.k OR a.user_id = b.user_id THEN 1 / 3.0::DOUBLE ELSE 0.0 END::DOUBLE AS label_similarity,
  greatest(1 - (b.us - a.us) / {10 * DAY}, 0)::DOUBLE AS time_similarity FROM a JOIN a b ON b.us >= a.us AND b.us - a.us <= {10 * DAY} AND (b.us > a.us OR b.id > a.id)),
q AS (SELECT *, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1) AS text_similarity FROM p WHERE label_similarity > 0)
SELECT a, b, round(label_similarity, 6) AS label_similarity, round(text_similarity, 6) AS text_similarity, round(time_similarity, 6) AS time_similarity, round(0.4 * label_similarity + 0.4 * text_similarity + 0.2 * time_similarity, 6) AS similarity
FROM q WHERE round(0.4::DOUBLE * label_similarity + 0.4::DOUBLE * text_similarity + 0.2::DOUBLE * time_similarity, 9) >= 0.62""")
def alike_alerts(spark, sf_dir):
    a = AL.alike(alerts(spark, sf_dir).withColumnRenamed("fingerprint", "text"), 10 * DAY, 0.62)
    return rounded(a, "label_similarity", "text_similarity", "time_similarity", "similarity")


# --- health and traces ----------------------------------------------------------------------------------------------


def edges(spark, sf_dir) -> DataFrame:
    """Customers depend on nations, nations on regions."""
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dependent"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dependency"))
    return c.union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))


EDGES = "e AS (SELECT 'c' || c_custkey AS dependent, 'n' || c_nationkey AS dependency FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT dependency AS failed, dependent AS affected, 1 AS depth FROM e UNION SELECT r.failed, e.dependent, depth + 1 FROM r JOIN e ON e.dependency = r.affected) SELECT failed, affected, min(depth)::INT AS depth FROM r GROUP BY ALL")
def failure_impact(spark, sf_dir):
    return graphs.failure_impact(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, n AS (SELECT dependent AS node FROM e UNION SELECT dependency FROM e), l AS (SELECT node, 0 AS level FROM n UNION SELECT e.dependent, level + 1 FROM l JOIN e ON e.dependency = l.node),
b AS (SELECT node, max(level)::INT AS level FROM l GROUP BY node) SELECT node, level, row_number() OVER (ORDER BY level, node)::INT AS place FROM b""")
def topological_order(spark, sf_dir):
    return graphs.topological(edges(spark, sf_dir))


CHECKS = "c AS (SELECT 'c' || c_custkey AS name, 'n' || c_nationkey AS grp, CASE WHEN c_acctbal < 0 THEN 'unhealthy' WHEN c_acctbal < 1000 THEN 'degraded' ELSE 'healthy' END AS status FROM customer)"


def checks(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("c_acctbal") < 0, "unhealthy").when(F.col("c_acctbal") < 1000, "degraded").otherwise("healthy")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("grp"), status.alias("status"))


@query(f"WITH {CHECKS} SELECT grp, ['healthy', 'degraded', 'unhealthy'][max(CASE status WHEN 'healthy' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END)] AS status, count(*) AS checks, count(*) FILTER (WHERE status = 'unhealthy') AS unhealthy FROM c GROUP BY grp")
def health_rollup(spark, sf_dir):
    return graphs.rolled_up(checks(spark, sf_dir), ["grp"])


@query(f"WITH {CHECKS} SELECT avg((status = 'healthy')::INT) > 0.5 AS healthy FROM c")
def fleet_health(spark, sf_dir):
    return graphs.fleet_healthy(checks(spark, sf_dir).withColumn("level", F.when(F.col("status") == "healthy", "normal").otherwise("limited")))


@query(f"""WITH RECURSIVE {SPANS}, t AS (SELECT trace_id, span_id, 0 AS depth FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.trace_id = a.trace_id AND b.span_id = a.parent_span_id)
UNION ALL SELECT s.trace_id, s.span_id, depth + 1 FROM t JOIN s ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id) SELECT depth, count(*) AS spans FROM t GROUP BY depth""")
def trace_depths(spark, sf_dir):
    return graphs.trace_tree(spans(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("spans"))


@query(f"WITH {SPANS} SELECT trace_id, count(*) AS spans, count(*) FILTER (WHERE error) AS errors, max(end_us) - min(start_us) AS duration_us, arg_max(span_id, (end_us - start_us, -span_id)) AS slowest_span FROM s GROUP BY trace_id")
def trace_summary(spark, sf_dir):
    return graphs.trace_summary(spans(spark, sf_dir))


@query(f"WITH {SPANS}, k AS (SELECT trace_id, parent_span_id AS span_id, sum(end_us - start_us)::BIGINT AS children FROM s GROUP BY ALL) SELECT trace_id, span_id, end_us - start_us AS duration_us, end_us - start_us - coalesce(children, 0) AS self_us FROM s LEFT JOIN k USING (trace_id, span_id)")
def span_self_time(spark, sf_dir):
    return graphs.self_time(spans(spark, sf_dir))


@query(f"""WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY start_us DESC, trace_id DESC, span_id DESC) AS r FROM s), k AS (SELECT *, (row_number() OVER (PARTITION BY service ORDER BY start_us, trace_id, span_id) - 1) // 100 AS batch FROM r WHERE r <= 2048)
SELECT service, batch, count(*) AS spans, min(start_us) AS first_us FROM k GROUP BY ALL""")
def export_batches(spark, sf_dir):
    b = graphs.export_batches(spans(spark, sf_dir), ["start_us", "trace_id", "span_id"], "service")
    return b.groupBy("service", "batch").agg(F.count("*").alias("spans"), F.min("start_us").alias("first_us"))


@query(f"WITH {SPANS}, h AS (SELECT trace_id, span_id, '00-' || lpad(lower(to_hex(trace_id)), 32, '0') || '-' || lpad(lower(to_hex(span_id)), 16, '0') || '-01' AS traceparent FROM s) SELECT *, string_split(traceparent, '-')[2] AS parsed_trace, string_split(traceparent, '-')[3] AS parsed_span FROM h")
def traceparent(spark, sf_dir):
    h = spans(spark, sf_dir).select("trace_id", "span_id", L.traceparent(F.lower(F.lpad(F.hex("trace_id"), 32, "0")), F.lower(F.lpad(F.hex(F.col("span_id").cast("long")), 16, "0")), F.lit("01")).alias("traceparent"))
    p = L.parsed_traceparent(F.col("traceparent"))
    return h.select("*", p["trace_id"].alias("parsed_trace"), p["span_id"].alias("parsed_span"))


@query(f"""WITH {SPANS} SELECT '{{"traceId":"' || trace_id || '","id":"' || span_id || '",' || CASE WHEN parent_span_id IS NULL THEN '' ELSE '"parentId":"' || parent_span_id || '",' END || '"name":"' || operation || '","timestamp":' || start_us || ',"duration":' || (end_us - start_us) ||
  ',"localEndpoint":{{"serviceName":"' || service || '"}},"tags":{{"error":"' || error || '"}}}}' AS json FROM s""")
def zipkin_spans(spark, sf_dir):
    c = F.col
    s = {"trace_id": c("trace_id").cast("string"), "span_id": c("span_id").cast("string"), "parent_id": c("parent_span_id").cast("string"), "name": c("operation"), "start_us": c("start_us"), "duration_us": c("end_us") - c("start_us"), "service": c("service"), "tags": F.create_map(F.lit("error"), c("error").cast("string"))}
    return spans(spark, sf_dir).select(E.zipkin_span(s).alias("json"))


def jaeger_spans(spark, sf_dir):
    c = F.col
    s = {"trace_id": c("trace_id").cast("string"), "span_id": c("span_id").cast("string"), "parent_id": c("parent_span_id").cast("string"), "name": c("operation"), "start_us": c("start_us"), "duration_us": c("end_us") - c("start_us"), "tags": F.create_map(F.lit("service"), c("service"))}
    return spans(spark, sf_dir).select(E.jaeger_span(s).alias("json"))


QUERIES["jaeger_spans"] = jaeger_spans


@query(f"WITH {SPANS} SELECT trace_id, span_id, 'server' AS kind, CASE WHEN error THEN 'error' ELSE 'ok' END AS status, service AS service_tag FROM s")
def otel_spans(spark, sf_dir):
    tags = F.create_map(F.lit("span.kind"), F.lit("server"), F.lit("error"), F.col("error").cast("string"), F.lit("service.name"), F.col("service"))
    kind, status, rest = E.otel_span(tags)
    return spans(spark, sf_dir).select("trace_id", "span_id", kind.alias("kind"), status.alias("status"), rest["service.name"].alias("service_tag"))


# --- text forms -----------------------------------------------------------------------------------------------------


@query("""WITH {m} SELECT '# HELP app_' || name || ' ' || chr(10) || '# TYPE app_' || name || ' gauge' || chr(10) || 'app_' || name || '{component="web",k="' || k || '",user_id="' || user_id || '"} ' || row_id || ' ' || (us // 1000) AS text FROM m""")
def prometheus_text(spark, sf_dir):
    m = E.exporter_rows(metrics(spark, sf_dir), "component", F.lit("web"), {})
    name = F.concat(F.lit("app."), "name")
    return m.select(E.prometheus_text(name, F.col("row_id"), F.col("labels"), F.floor(F.col("us") / 1000), L.inferred_type(name)).alias("text"))


@query("""WITH {m} SELECT 'app_' || name || '_total:' || row_id || '|c|#k:' || k || ',user_id:' || user_id AS line FROM m""")
def statsd_lines(spark, sf_dir):
    name = F.concat(F.lit("app."), "name", F.lit(" total"))
    return metrics(spark, sf_dir).select(E.statsd_line(name, F.col("row_id"), L.inferred_type(name, timers=True), tags=F.col("tags")).alias("line"))


@query("""WITH {m} SELECT name || ',k=' || k || ',user_id=' || user_id || ' value=' || row_id || ' ' || (us * 1000) AS line FROM m""")
def influx_lines(spark, sf_dir):
    return metrics(spark, sf_dir).select(E.influx_line(F.col("name"), F.col("row_id"), F.col("tags"), F.col("us")).alias("line"))


@query("""WITH {m} SELECT row_id, '{"name":"' || name || '","' || CASE WHEN name = 'click' THEN 'sum":{"aggregationTemporality":2,"isMonotonic":true,' ELSE 'gauge":{' END || '"dataPoints":[{"attributes":[{"key":"k","value":{"stringValue":"' || k || '"}},{"key":"user_id","value":{"stringValue":"' || user_id || '"}}],"timeUnixNano":"' || (us * 1000) || '","asDouble":' || row_id || '}]}}' AS json FROM m""")
def otlp_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).select("row_id", E.otlp_metric(F.col("name"), F.col("row_id"), F.col("tags"), F.col("us"), F.col("name") == "click").alias("json"))


@query("""WITH {m} SELECT row_id, name || ';k=' || k || ';user_id=' || user_id AS key, name || '{k=' || k || ',user_id=' || user_id || ',}' AS fingerprint, list_reduce(list_prepend(2166136261::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(name, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv,
  list_reduce(list_prepend(0::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(name, '')]), lambda h, c: (h * 31 + c) & 4294967295) AS poly FROM m""")
def keys_and_hashes(spark, sf_dir):
    n, t = F.col("name"), F.col("tags")
    return metrics(spark, sf_dir).select("row_id", L.metric_key(n, t).alias("key"), L.fingerprint(n, t).alias("fingerprint"), L.fnv1a_32(n).alias("fnv"), L.poly31_32(n).alias("poly"))


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 2 THEN '**' ELSE left(c_name, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1) END AS masked, least(100.0 * power(2, c_custkey % 10), 5000)::DOUBLE AS exponential, least(100.0 * (c_custkey % 10 + 1), 700)::DOUBLE AS linear,
  'Customer ' || c_name || ' ${unknown} has ' || c_nationkey AS text FROM customer""")
def text_functions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    attempt = F.col("c_custkey") % 10 + 1
    text = L.rendered("Customer ${name} ${unknown} has ${nation}", {"name": F.col("c_name"), "nation": F.col("c_nationkey").cast("string")})
    return c.select("c_custkey", L.masked_user(F.col("c_name")).alias("masked"), L.retry_delay("exponential", attempt, 100, 5000).alias("exponential"), L.retry_delay("linear", attempt, 100, 700).alias("linear"), text.alias("text"))


# --- orders ---------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, user_id LIMIT 20")
def top_duplicates(spark, sf_dir):
    return ordering.top(read(spark, sf_dir, "events"), "user_id", 20)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 50")
def pagination(spark, sf_dir):
    return ordering.page(read(spark, sf_dir, "events").select("event_id", "value"), [F.desc("value"), F.col("event_id")], 50, 25)


@query("WITH p AS (SELECT event_type, event_id, event_id % 4 AS priority, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 4 DESC, event_id) AS place FROM events) SELECT * FROM p WHERE place <= 256")
def priority_buffer(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "event_id", (F.col("event_id") % 4).alias("priority"))
    return ordering.priority_buffer(e, ["event_type"], "priority", "event_id", 256)


@query("""WITH x AS (SELECT p_brand, p_name, p_partkey, p_size, count(*) OVER w AS n, avg(p_size * 2) OVER w AS cpu FROM part WINDOW w AS (PARTITION BY p_brand)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM x)
SELECT p_brand, p_partkey, place FROM r WHERE place <= CASE WHEN cpu > 80 THEN greatest(1, floor(n * 0.2)) WHEN cpu > 60 THEN greatest(2, floor(n * 0.5)) WHEN cpu > 40 THEN greatest(3, floor(n * 0.75)) ELSE n END""")
def active_collectors(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("cpu", F.col("p_size") * 2)
    return ordering.active_collectors(p, "p_brand", "p_size", "p_partkey", "cpu").select("p_brand", "p_partkey", "place")


# --- derived metrics and buffers ------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, 'critical' AS level, 'cpu' AS name, least(100, value) AS value FROM events WHERE least(100, value) >= 90 UNION ALL SELECT user_id, event_id, 'warning', 'cpu', value FROM events WHERE value >= 75 AND value < 90
UNION ALL SELECT user_id, event_id, CASE WHEN event_id % 101 >= 95 THEN 'critical' ELSE 'warning' END, 'memory', (event_id % 101)::DOUBLE FROM events WHERE event_id % 101 >= 80""")
def resource_findings(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumns({"cpu": F.least(F.lit(100.0), "value"), "memory": F.col("event_id") % 101})
    return derived.findings(derived.melted(e, ["user_id", "event_id"], {"cpu": "cpu", "memory": "memory"}))


@query("""WITH p AS (SELECT p_partkey, p_size / 50 AS saturation, (p_partkey % 100) / 100 AS utilisation, (p_partkey % 13) / 100 AS failures, p_retailprice * 3 AS wait_ms FROM part),
i AS (SELECT p_partkey, list_filter([CASE WHEN saturation >= 0.9 THEN 'saturation:critical' WHEN saturation >= 0.7 THEN 'saturation:warning' END, CASE WHEN utilisation >= 0.9 THEN 'utilisation:critical' WHEN utilisation < 0.2 THEN 'utilisation:low' END,
  CASE WHEN failures >= 0.1 THEN 'failures:critical' WHEN failures >= 0.05 THEN 'failures:warning' END, CASE WHEN wait_ms >= 5000 THEN 'wait_ms:critical' WHEN wait_ms >= 1000 THEN 'wait_ms:warning' END], lambda x: x IS NOT NULL) AS x FROM p)
SELECT p_partkey, array_to_string(x, ',') AS issues, CASE WHEN len(list_filter(x, lambda y: ends_with(y, 'critical'))) > 0 THEN 'unhealthy' WHEN len(x) > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM i""")
def pool_health(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("saturation"), (F.col("p_partkey") % 100 / 100).alias("utilisation"), (F.col("p_partkey") % 13 / 100).alias("failures"), (F.col("p_retailprice") * 3).alias("wait_ms"))
    return derived.pool_issues(p).select("p_partkey", F.array_join("issues", ",").alias("issues"), "health")


@query("""WITH v AS (SELECT p_brand, p_name || p_partkey AS name, p_size AS used, 60 AS total, 100 * (p_size / 60) AS use FROM part)
SELECT p_brand, sum(used)::BIGINT AS used, sum(total)::BIGINT AS total, round(avg(use), 6) AS mean_use, round(max(use), 6) AS max_use, arg_min(name, (-use, name)) AS fullest FROM v GROUP BY p_brand""")
def volume_totals(spark, sf_dir):
    v = read(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("used"), F.lit(60).alias("total"))
    return rounded(derived.totals(v, ["p_brand"], "used", "total", "name"), "mean_use", "max_use")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) AS total FROM events GROUP BY user_id")
def counts_by_kind(spark, sf_dir):
    return derived.counts_by_kind(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error", "view"])


@query("""WITH l AS (SELECT event_type AS c, user_id % 20 AS k, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) SELECT c || '.' || k AS name, value FROM l UNION ALL SELECT c || '.metric_count', count(*)::DOUBLE FROM l GROUP BY c""")
def component_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", (F.col("user_id") % 20).cast("string"))
    return derived.merged_components(e, "event_type", ["ts", "event_id"])


@query("SELECT o_orderpriority, count(*) AS attempts, round(avg((o_orderstatus <> 'F')::INT), 6) AS success_rate, round(avg((o_orderstatus = 'F')::INT), 6) AS failure_rate, round(sum(o_totalprice) / count(*), 4) AS mean_size FROM orders GROUP BY 1")
def transaction_ratios(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") != "F")
    return rounded(rounded(derived.ratios(o, ["o_orderpriority"], "ok", "o_totalprice"), "success_rate", "failure_rate"), "mean_size", digits=4)


@query(f"""WITH l AS (SELECT event_type AS level, epoch_us(ts) AS us, length(props) AS bytes, CASE event_type WHEN 'error' THEN 480 WHEN 'click' THEN 24 WHEN 'view' THEN 120 ELSE 0 END AS h FROM events)
SELECT level, count(*) FILTER (WHERE us >= {T0 + 29 * DAY} - h * {HOUR}) AS kept, count(*) FILTER (WHERE us < {T0 + 29 * DAY} - h * {HOUR}) AS expired, coalesce(sum(bytes) FILTER (WHERE us >= {T0 + 29 * DAY} - h * {HOUR}), 0)::BIGINT AS kept_bytes FROM l GROUP BY level""")
def log_storage(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("level"), micros(F.col("ts")).alias("us"), F.length("props").alias("bytes"))
    return derived.log_storage(e, {"error": 480, "click": 24, "view": 120}, T0 + 29 * DAY)


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE value::VARCHAR END AS t FROM events), d AS (SELECT event_id, coalesce(try_cast(t AS DOUBLE), 0) AS x FROM v) SELECT event_id, x AS as_double, trunc(x)::BIGINT AS as_long, printf('%.6f', x) AS as_text FROM d""")
def variant_coercions(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in derived.coerced(t).items()])


@query(f"""WITH {{m}}, b AS (SELECT name, 'size' AS kind, ((row_number() OVER (PARTITION BY name ORDER BY us, row_id) - 1) // 64)::VARCHAR AS batch FROM m UNION ALL SELECT name, 'time', (us // {6 * HOUR})::VARCHAR FROM m
  UNION ALL SELECT name, 'priority', coalesce(sum((row_id % 16 = 15)::INT) OVER (PARTITION BY name ORDER BY us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::VARCHAR FROM m), c AS (SELECT kind, name, batch, count(*) AS n FROM b GROUP BY ALL)
SELECT kind, name, count(*) AS flushes, sum(n)::BIGINT AS rows, round(avg(n), 6) AS mean_rows, round(avg(n) / 64, 6) AS efficiency, count(*) FILTER (WHERE n >= 64) AS full FROM c GROUP BY kind, name""")
def buffer_flushes(spark, sf_dir):
    m, order = metrics(spark, sf_dir), ["us", "row_id"]
    parts = {"size": buffers.by_size(m, "name", order, 64), "time": buffers.by_time(m, 6 * HOUR), "priority": buffers.by_priority(m.withColumn("p", F.col("row_id") % 16), "name", order, "p", 15)}
    rows = [df.select(F.lit(k).alias("kind"), "name", F.col("batch").cast("string").alias("batch")) for k, df in parts.items()]
    return rounded(buffers.statistics(storage.collected(*rows), ["kind", "name"], 64), "mean_rows", "efficiency")


@query("""WITH {m}, a AS (SELECT name, row_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, row_id DESC) AS p FROM m) WHERE p <= 50), b AS (SELECT name, row_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us, row_id) AS p FROM m) WHERE p <= 50)
SELECT 'drop_oldest' AS policy, * FROM a UNION ALL SELECT 'drop_newest', * FROM b""")
def overflow_policies(spark, sf_dir):
    m = metrics(spark, sf_dir)
    kept = [buffers.kept(m, ["name"], ["us", "row_id"], 50, p).select(F.lit(p).alias("policy"), "name", "row_id") for p in ("drop_oldest", "drop_newest")]
    return storage.collected(*kept)


@query("""WITH {m}, r AS (SELECT 'ramp' AS name, (i * 1000000)::BIGINT AS us, i::DOUBLE AS value FROM range(0, (SELECT count(*) FROM events)) t(i)), u AS (SELECT name, us, value FROM m UNION ALL SELECT * FROM r)
SELECT name, count(*) AS rows, max(us) AS last_us, round(max(value), 6) AS most FROM u GROUP BY name""")
def collector_source(spark, sf_dir):
    """A collector's rows, as many as there are events, beside the events."""
    m = metrics(spark, sf_dir).select("name", "us", "value")
    both = storage.collected(m, collectors.collect(spark, "tidemark.sources.collectors:ramp", 4, rows=str(m.count())))
    return rounded(both.groupBy("name").agg(F.count("*").alias("rows"), F.max("us").alias("last_us"), F.max("value").alias("most")), "most")


@query(f"""WITH {{m}}, {ALERTS} SELECT id, '[' || upper(severity) || '] ' || name || ' is firing (value ' || printf('%.2f', value) || ')' AS text FROM a""")
def alert_text(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return a.select("id", E.alert_text(F.col("name"), F.col("severity"), F.col("state"), F.col("value")).alias("text"))


@query(f"""WITH {{m}}, {ALERTS}, d AS (SELECT *, us - lag(us) OVER (PARTITION BY name, k ORDER BY us, id) AS gap FROM a) SELECT name, k, count(*) AS alerts, count(*) FILTER (WHERE gap IS NULL OR gap >= {DAY}) AS first_in_window FROM d GROUP BY ALL""")
def time_window_dedup(spark, sf_dir):
    a = T.absences(alerts(spark, sf_dir).withColumn("key", F.struct("name", F.col("labels")["k"].alias("k"))), "key", ["us", "id"], DAY - 1)
    return a.groupBy("key.name", "key.k").agg(F.count("*").alias("alerts"), F.count_if(F.col("gap_us").isNull() | F.col("absent")).alias("first_in_window"))


# --- streams --------------------------------------------------------------------------------------------------------


def stream(spark, sf_dir) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return jobs.event_stream(spark, sf_dir, "events.parquet", schema).withColumnRenamed("event_type", "name")


def stream_folder(spark) -> str:
    return f"{shared_root(spark)}/streams"


def with_us(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, micros(F.col(name)))


@query(f"""WITH {{m}} SELECT name, us // {DAY} * {DAY} AS window_start, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min_value, max(value) AS max_value, round(stddev_samp(value), 6) AS std_dev FROM m GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    out = jobs.run_complete(jobs.windowed_rules(stream(spark, sf_dir), "1 day", "1 hour"), stream_folder(spark))
    return rounded(rounded(with_us(out, "window_start"), "mean", "std_dev"), "sum", digits=4)


@query(f"""WITH {{m}}, w AS (SELECT *, unnest([us // {6 * HOUR} * {6 * HOUR}, us // {6 * HOUR} * {6 * HOUR} - {6 * HOUR}]) AS window_start FROM m) SELECT name, window_start, count(*) AS count, round(sum(value), 4) AS sum FROM w GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    out = jobs.run_complete(jobs.windowed_rules(stream(spark, sf_dir), "12 hours", "1 hour", "6 hours"), stream_folder(spark))
    return rounded(with_us(out, "window_start").select("name", "window_start", "count", "sum"), "sum", digits=4)


@query(f"""WITH {{m}}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, row_id) < {DAY} THEN 0 ELSE 1 END AS cut FROM m), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY us, row_id) AS i FROM g)
SELECT user_id, min(us) AS session_start, max(us) + {DAY} AS session_end, count(*) AS count, round(sum(value), 4) AS sum FROM s GROUP BY user_id, i""")
def stream_sessions(spark, sf_dir):
    out = jobs.run_complete(jobs.sessions(stream(spark, sf_dir), "user_id", "1 day", "1 hour"), stream_folder(spark))
    return rounded(with_us(with_us(out, "session_start"), "session_end"), "sum", digits=4)


@query("SELECT DISTINCT user_id, event_type AS name FROM events")
def stream_dedup(spark, sf_dir):
    return jobs.run_available(jobs.first_seen(stream(spark, sf_dir), ["user_id", "name"], "40 days"), stream_folder(spark)).select("user_id", "name")


@query(STATES_SQL + ", c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY name ORDER BY rn), 'inactive') AS before FROM s) SELECT name AS key, us, state FROM c WHERE state <> before")
def stream_alert_states(spark, sf_dir):
    s = stream(spark, sf_dir).select("name", micros(F.col("ts")).alias("us"), "event_id", (F.col("value") > 60).alias("met"))
    return jobs.run_available(jobs.alert_states(s, "name", "us", "met", 10 * MINUTE, "event_id"), stream_folder(spark))


# --- timers ---------------------------------------------------------------------------------------------------------

#: Up to when a stream has worked that is 1 hour behind its newest row.
UNTIL_SQL = "((SELECT max(us) FROM m) // 1000 - 3600001) * 1000"
FLUSHES_SQL = f"""WITH {{m}}, r AS (SELECT user_id AS key, name AS f, us, value > 30 AS firing, lead(us) OVER o AS nxt, lag(us) OVER o AS prev, lag(value > 30) OVER o AS prev_on, row_id FROM m WINDOW o AS (PARTITION BY user_id, name ORDER BY us, row_id)),
i AS (SELECT *, coalesce(nxt, 4611686018427387904) AS e, sum((prev IS NULL OR (NOT prev_on AND us >= prev + {12 * HOUR}))::INT) OVER (PARTITION BY key, f ORDER BY us, row_id) AS n FROM r),
x AS (SELECT key, f, min(us) AS s, max(CASE WHEN firing THEN e ELSE least(e, us + {12 * HOUR}) END) AS e FROM i GROUP BY key, f, n),
l AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM x),
v AS (SELECT *, sum((far IS NULL OR s >= far)::INT) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS life FROM l),
g AS (SELECT key, min(s) AS s, max(e) AS e FROM v GROUP BY key, life),
t AS (SELECT key, unnest(range(s + {6 * HOUR}, least(e, {UNTIL_SQL} + 1), {DAY})) AS us FROM g),
a AS (SELECT t.key, t.us, count(*) AS size FROM t JOIN x ON x.key = t.key AND x.s < t.us AND t.us < x.e GROUP BY ALL),
b AS (SELECT t.key, t.us, count(*) AS firing FROM t JOIN i ON i.key = t.key AND i.firing AND i.us < t.us AND t.us <= i.e GROUP BY ALL)
SELECT key::VARCHAR AS key, a.us AS us, size, coalesce(firing, 0) AS firing FROM a LEFT JOIN b USING (key, us)"""


def newest_us(spark, sf_dir) -> int:
    return metrics(spark, sf_dir).agg(F.max("us")).first()[0]


@query(FLUSHES_SQL)
def timed_group_flushes(spark, sf_dir):
    m = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("name"), micros(F.col("ts")).alias("us"), F.col("event_id").alias("row_id"), (F.col("value") > 30).alias("firing"))
    until = timers.horizon_us(newest_us(spark, sf_dir), 3_600_000)
    return AL.timed_flushes(m, "user", "name", ["us", "row_id"], "firing", 6 * HOUR, DAY, 12 * HOUR, until)


@query(FLUSHES_SQL)
def stream_group_flushes(spark, sf_dir):
    s = stream(spark, sf_dir).select("ts", F.col("user_id").alias("user"), micros(F.col("ts")).alias("us"), "event_id", F.col("name"), (F.col("value") > 30).alias("firing"))
    return jobs.run_available(timers.folded(s, "user", ["us", "event_id"], ["name", "firing"], timers.GroupTimer(6 * HOUR, DAY, 12 * HOUR), timers.GroupTimer.SCHEMA, 3_600_000), stream_folder(spark))


def cached_sql(compat: bool, until: str = "") -> str:
    """The cache as a recursive statement, by user and name, with two states."""
    return f"""WITH RECURSIVE {{m}}, e AS (SELECT user_id || '/' || name AS key, us, row_id, CASE WHEN value > 30 THEN 'firing' ELSE 'resolved' END AS state, row_number() OVER (PARTITION BY user_id, name ORDER BY us, row_id) AS rn FROM m),
c AS (SELECT key, rn, us, row_id, state, us AS first, {"NULL::VARCHAR" if compat else "state"} AS last, true AS pass FROM e WHERE rn = 1 UNION ALL
SELECT e.key, e.rn, e.us, e.row_id, e.state, CASE WHEN e.us - c.first > {4 * DAY} THEN e.us ELSE c.first END, CASE WHEN e.us - c.first > {4 * DAY} THEN {"NULL" if compat else "e.state"} ELSE e.state END, e.us - c.first > {4 * DAY} OR c.last IS NULL OR c.last <> e.state FROM c JOIN e ON e.key = c.key AND e.rn = c.rn + 1)
SELECT key, us, row_id AS id, state FROM c WHERE pass{until}"""


def keyed(df: DataFrame, id_: str) -> DataFrame:
    state = F.when(F.col("value") > 30, "firing").otherwise("resolved")
    return df.withColumns({"key": F.concat_ws("/", "user", "name"), "state": state}).withColumnRenamed(id_, "id")


@query(cached_sql(True))
def cached_dedup(spark, sf_dir):
    m = keyed(metrics(spark, sf_dir).withColumn("user", F.col("tags")["user_id"]), "row_id").select("key", "us", "id", "state")
    return AL.cached(m, ["key"], ["us", "id"], "state", 4 * DAY, compat=True)


@query(cached_sql(False, f" AND us <= {UNTIL_SQL}"))
def stream_cached_dedup(spark, sf_dir):
    s = keyed(stream(spark, sf_dir).withColumnsRenamed({"user_id": "user"}), "event_id").withColumn("us", micros(F.col("ts")))
    return jobs.run_available(timers.folded(s, "key", ["us", "id"], ["id", "state"], timers.CacheTimer(4 * DAY), timers.CacheTimer.SCHEMA, 3_600_000), stream_folder(spark))


@query(STATES_SQL + f""", c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY name ORDER BY rn), 'inactive') AS before FROM s) SELECT name AS key, us, state FROM c WHERE state <> before AND us <= {UNTIL_SQL}""")
def stream_timed_states(spark, sf_dir):
    """No metric is silent for a month here, so the states are those without a timeout, up to the watermark."""
    s = stream(spark, sf_dir).select("ts", "name", micros(F.col("ts")).alias("us"), "event_id", (F.col("value") > 60).alias("met"))
    return jobs.run_available(timers.folded(s, "name", ["us", "event_id"], ["met"], timers.StateTimer(10 * MINUTE, 30 * DAY, 30 * DAY), timers.StateTimer.SCHEMA, 3_600_000), stream_folder(spark))
