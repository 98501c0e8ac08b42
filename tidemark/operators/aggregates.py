"""Statistics of samples: moments, percentiles, histograms, timers, profiles, rule outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import guarded

#: Upper bounds of the standard histogram (fixed values).
STANDARD_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)


def stream_stats(df: DataFrame, by: list[str], value: str = "value", us: str = "us") -> DataFrame:
    """Count, mean, sample variance and deviation (0 below two rows), extremes, sum, skewness, kurtosis (normal: 3),
    coefficient of variation, quartiles, interquartile range and rate a second, in one aggregation."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    two = F.count(v) >= 2
    return df.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.when(two, F.var_samp(v)).otherwise(0.0).alias("variance"), F.when(two, F.stddev_samp(v)).otherwise(0.0).alias("std_dev"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum"), F.when(two, F.skewness(v)).alias("skewness"), F.when(two, F.kurtosis(v) + 3).alias("kurtosis"),
        F.when(two, guarded(F.stddev_samp(v), F.abs(F.avg(v)))).otherwise(0.0).alias("cv"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"),
        guarded(F.count(v).cast("double"), (F.max(us) - F.min(us)) / 1e6).alias("rate_per_second"))


def percentiles(value: Column, points: tuple[float, ...] = QUANTILES, exact: bool = True) -> Column:
    """Percentiles with linear interpolation, or from a bounded sketch."""
    at = F.array(*map(F.lit, points))
    return F.percentile(value, at) if exact else F.percentile_approx(value, at, F.lit(10000))


def nearest_rank(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """The value at index round(p (n - 1)) of each group's sorted values, found by row number, so no group is collected."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(value)
    ranked = df.select(*by, value, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy(*by)).alias("n"))
    picks = [F.max(F.when(F.col("i") == F.floor(F.lit(p) * (F.col("n") - 1) + 0.5), F.col(value))).alias(f"p{round(p * 100, 3):g}".replace(".", "_")) for p in points]
    return ranked.groupBy(*by).agg(*picks)


def histogram(df: DataFrame, by: list[str], value: str = "value", bounds: tuple[float, ...] = STANDARD_BOUNDS) -> DataFrame:
    """Cumulative counts ``le, bucket_count`` for each bound, with count and sum, from one pass."""
    counts = df.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)])
    cells = F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"_b{i}").alias("bucket_count")) for i, b in enumerate(bounds)])
    return counts.select(*by, "count", "sum", F.inline(cells))


def summary(df: DataFrame, by: list[str], value: str = "value", us: str | None = None) -> DataFrame:
    """Count, sum, mean, median, population deviation, extremes, p95 and p99 of a buffer; with ``us`` also its oldest and newest time."""
    q = percentiles(F.col(value), (0.5, 0.95, 0.99))
    ages = [F.min(us).alias("oldest_us"), F.max(us).alias("newest_us")] if us else []
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.sum(value).alias("total"), F.avg(value).alias("mean"), q[0].alias("median"), F.stddev_pop(value).alias("std_dev"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), q[1].alias("p95"), q[2].alias("p99"), *ages)


def timer(df: DataFrame, by: list[str], value: str, points: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Count, mean, population deviation and percentiles of all samples (no reservoir)."""
    q = percentiles(F.col(value), points)
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), *[q[i].alias(f"p{round(p * 100, 3):g}".replace(".", "_")) for i, p in enumerate(points)])


def profile(df: DataFrame, by: str, duration: str, ok: str, us: str) -> DataFrame:
    """Calls, errors, total, extremes and whole mean duration of each operation, its success rate and throughput."""
    seconds = (F.max(us) - F.min(us)) / 1e6
    return df.groupBy(by).agg(
        F.count("*").alias("calls"), F.count_if(~F.col(ok)).alias("errors"), F.sum(duration).alias("total_ns"), F.min(duration).alias("min_ns"), F.max(duration).alias("max_ns"),
        F.expr(f"sum({duration}) div count(*)").alias("mean_ns"), F.avg(F.col(ok).cast("double")).alias("success_rate"), guarded(F.count("*").cast("double"), seconds).alias("throughput"))


def tagged(df: DataFrame, key: Column, kind: Column, order: list[str]) -> DataFrame:
    """Counters are summed, gauges keep their newest value, by key."""
    return df.groupBy(key.alias("key"), kind.alias("type")).agg(
        F.when(F.first("type") == "counter", F.sum("value")).otherwise(F.max_by("value", F.struct(*order))).alias("value"), F.count("*").alias("points"))


def rule_outputs(df: DataFrame, rules: DataFrame, interval_us: int, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Derived metrics ``metric, window_start, value``: ``prefix.mean``, ``.min``, ``.max``, ``.stddev``, ``.count``, ``.pNN``.

    ``rules(source_metric, prefix)`` is joined on the metric's name (small by nature, so Spark may broadcast it); windows
    begin at multiples of the interval.
    """
    window = (F.floor(F.col("us") / interval_us) * interval_us).cast("long").alias("window_start")
    q = percentiles(F.col("value"), points)
    wide = df.join(rules, df["name"] == rules["source_metric"]).groupBy("prefix", window).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"), F.count("*").cast("double").alias("count"),
        *[q[i].alias(f"p{round(p * 100, 3):g}") for i, p in enumerate(points)])
    names = ["mean", "min", "max", "stddev", "count", *[f"p{round(p * 100, 3):g}" for p in points]]
    cells = F.array(*[F.struct(F.concat(F.col("prefix"), F.lit(f".{n}")).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])
    return wide.select("window_start", F.inline(cells)).select("metric", "window_start", "value")


def unique_values(df: DataFrame, by: list[str], value: str, exact: bool = True) -> DataFrame:
    return df.groupBy(*by).agg((F.count_distinct(value) if exact else F.approx_count_distinct(value)).alias("unique_values"))


def metric_query(
    metrics: DataFrame, select: list[str] | None = None, where: Column | None = None, start_us: int | None = None, end_us: int | None = None,
    group_tags: tuple[str, ...] = (), group_time_us: int | None = None, aggregates: dict[str, Column] | None = None, order_by: list[Column] | None = None, limit: int | None = None, now_us: int | None = None,
) -> DataFrame:
    """Metrics by name, time and predicate, grouped by tags and time, as DataFrame calls that Spark optimises.

    With ``now_us``, negative times count back from it (-3600000000: an hour ago).

    Unary and binary expressions, functions and user-defined aggregates are Spark columns; bind values, don't build text.
    """
    df = metrics
    if now_us is not None:
        start_us, end_us = (now_us + t if t is not None and t < 0 else t for t in (start_us, end_us))
    if select:
        df = df.where(F.col("name").isin(select))
    if start_us is not None:
        df = df.where(F.col("us") >= start_us)
    if end_us is not None:
        df = df.where(F.col("us") < end_us)
    if where is not None:
        df = df.where(where)
    keys = [F.col("name")] + [F.try_element_at("tags", F.lit(t)).alias(t) for t in group_tags]
    if group_time_us:
        keys.append((F.floor(F.col("us") / group_time_us) * group_time_us).cast("long").alias("time"))
    if aggregates:
        df = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(limit) if limit is not None else df


def effective_sample_rate(df: DataFrame, by: list[str], kept: str) -> DataFrame:
    """The share of samples that were collected rather than dropped; 1.0 where there are none."""
    n = F.count(kept)
    return df.groupBy(*by).agg(F.when(n > 0, F.count_if(F.col(kept)) / n).otherwise(1.0).alias("sample_rate"))


def operation_metrics(df: DataFrame, by: str, duration: str, ok: str, order: list[str], samples: int = 10_000) -> DataFrame:
    """Calls and errors of all rows; extremes, mean, median, p95, p99 and total of each operation's newest ``samples``.

    The newest rows are cut before they are shuffled, so percentiles are taken of a bounded number of values.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(~F.col(ok)).alias("errors"))
    newest = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= samples)
    d = F.col(duration)
    q = F.percentile(d, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    stats = newest.groupBy(by).agg(F.min(d).alias("min_value"), F.max(d).alias("max_value"), F.avg(d).alias("mean"), q[0].alias("median"), q[1].alias("p95"), q[2].alias("p99"), F.sum(d).alias("total"))
    return counts.join(stats, by)


def by_type(df: DataFrame, kind: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of the included types (all if none is named) without the excluded ones."""
    keep = kind.isin(*include) if include else F.lit(True)
    return df.where(keep & ~kind.isin(*exclude) if exclude else keep)


def column_summaries(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """:func:`summary` of several columns of a wide sample, each under its name."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).cast("double").alias("value")) for c, n in columns.items()])
    return summary(df.select(*by, F.inline(cells)), [*by, "column"])
