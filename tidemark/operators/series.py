"""Time series: range queries by step, newest values, retention, compression, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import micros, step_start
from .scans import SLICE_US, entering, last_known, sliced


def guarded(numerator: Column, denominator: Column) -> Column:
    """The quotient, or 0.0 where the denominator is 0 or null."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def range_query(series: DataFrame, start_us: int, end_us: int, step_us: int, names: list[str] | None = None) -> DataFrame:
    """``name, step_start, ts, value, sample_count`` of ``series(name, us, value, n)`` for start <= us < end.

    Steps begin at ``start_us``; a step's value is the mean weighted by ``n``, ``ts`` its newest time; empty steps don't
    appear. The filters reach the scan, and sums combine before the shuffle.
    """
    s = series.where((F.col("us") >= start_us) & (F.col("us") < end_us))
    if names:
        s = s.where(F.col("name").isin(names))
    return s.groupBy("name", step_start(F.col("us"), start_us, step_us).alias("step_start")).agg(
        F.max("us").alias("ts"), guarded(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("value"), F.sum("n").cast("long").alias("sample_count"))


def range_summary(points: DataFrame) -> DataFrame:
    """Of a range query's result by name: steps, samples, mean, extremes, and the rate by whole seconds (0 below one)."""
    seconds = F.floor((F.max("ts") - F.min("ts")) / 1_000_000)
    rate = guarded(F.max_by("value", "ts") - F.min_by("value", "ts"), seconds)
    return points.groupBy("name").agg(
        F.count("*").alias("steps"), F.sum("sample_count").alias("total_samples"), guarded(F.sum(F.col("value") * F.col("sample_count")), F.sum("sample_count")).alias("average"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), rate.alias("rate"))


def gap_filled(points: DataFrame, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """A range query's result with a row for every step of each name; absent steps have null values and no samples."""
    steps = points.select("name").distinct().select("name", F.explode(F.sequence(F.lit(start_us), F.lit(end_us - 1), F.lit(step_us))).alias("step_start"))
    return steps.join(points, ["name", "step_start"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def catalogue(metrics: DataFrame) -> DataFrame:
    """Each name's points, first and last time, newest value (ties: largest id), and label keys in order."""
    return metrics.groupBy("name").agg(
        F.count("*").alias("points"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("value", F.struct("us", "row_id")).alias("latest"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("tags"))))), ",").alias("label_keys"))


def newest(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key, as a ring buffer keeps them, with their ``rank``; kept rows are cut before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def last_write(df: DataFrame, key: str, order: list[str], value: str, removed: Column | None = None) -> DataFrame:
    """The last value written under each key; keys whose last row is a removal are absent."""
    if removed is None:
        return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    last = df.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v"), removed.alias("gone")), F.struct(*order)).alias("_last"))
    return last.where(~F.col("_last.gone")).select(key, F.col("_last.v").alias(value))


def retained(series: DataFrame, as_of_us: int, keep_us: int, idle: bool = False) -> DataFrame:
    """Rows not older than ``keep_us``; with ``idle``, all rows of names whose newest row isn't."""
    if not idle:
        return series.where(F.col("us") >= as_of_us - keep_us)
    alive = series.groupBy("name").agg(F.max("us").alias("newest")).where(F.col("newest") >= as_of_us - keep_us).select("name")
    return series.join(alive, "name", "left_semi")


def compressed(series: DataFrame, threshold: float, order: list[str] | None = None, slice_us: int = SLICE_US) -> DataFrame:
    """Drops inner points within ``threshold`` of the line between their original neighbours; ends stay."""
    order = order or ["us"]
    rows = with_previous(with_previous(series, "name", order, ["us", "value"], slice_us), "name", order, ["us", "value"], slice_us, ahead="following")
    us, value = F.col("us"), F.col("value")
    before, after, v, u = F.col("previous.us"), F.col("following.us"), F.col("previous.value"), F.col("following.value")
    line = v + (u - v) * guarded((us - before).cast("double"), (after - before).cast("double"))
    return rows.where(F.col("previous").isNull() | F.col("following").isNull() | (F.abs(value - line) > threshold)).drop("previous", "following")


def calculus(series: DataFrame, order: list[str], slice_us: int = SLICE_US) -> DataFrame:
    """Delta, rate a second, mean derivative and trapezoid integral (value seconds) of each name."""
    rows = with_previous(series, "name", order, ["us", "value"], slice_us)
    s = rows.withColumn("dt", (F.col("us") - F.col("previous.us")) / 1e6).withColumn("prev", F.col("previous.value"))
    key = F.struct(*order)
    delta = F.max_by("value", key) - F.min_by("value", key)
    return s.groupBy("name").agg(
        delta.alias("delta"), guarded(delta, (F.max("us") - F.min("us")) / 1e6).alias("rate"),
        F.avg(F.when(F.col("dt") > 0, (F.col("value") - F.col("prev")) / F.col("dt"))).alias("derivative"),
        F.sum((F.col("value") + F.col("prev")) / 2 * F.col("dt")).alias("integral"))


def counter_rates(series: DataFrame, order: list[str], slice_us: int = SLICE_US, whole: bool = False, scale: int = 1) -> DataFrame:
    """Each row's increase a second since the row before, times ``scale`` (``whole``: cut off to a whole number); null after a reset, for the first row and for no time.

    The increase is scaled, not the values: scaled values round each for themselves, and a whole rate just reached would be cut off below.
    """
    rows = with_previous(series, "name", order, ["us", "value"], slice_us)
    before, dt = F.col("previous.value"), (F.col("us") - F.col("previous.us")) / 1e6
    rate = F.when((before > 0) & (F.col("value") >= before) & (dt > 0), (F.col("value") - before) * F.lit(float(scale)) / dt)
    return rows.withColumn("rate", rate.cast("long") if whole else rate).drop("previous")


def busy_percent(series: DataFrame, idle: str, total: str, by: str, order: list[str], slice_us: int = SLICE_US) -> DataFrame:
    """100 (1 - change of idle / change of total) of two running counters; 0 without change.

    Rows that are equal in ``order`` follow one another by their counters, as these only grow.
    """
    rows = with_previous(series, by, [*order, total, idle], [idle, total], slice_us)
    change = F.col(total) - F.col(f"previous.{total}")
    part = guarded((F.col(idle) - F.col(f"previous.{idle}")).cast("double"), change.cast("double"))
    return rows.withColumn("busy", F.when(change > 0, 100 * (1 - part)).otherwise(0.0)).drop("previous")


def correlation(left: DataFrame, right: DataFrame, start_us: int, step_us: int) -> DataFrame:
    """Pearson's r of two series' step means; 0 for fewer than two common steps or no variance."""
    def steps(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(step_start(F.col("us"), start_us, step_us).alias("step_start")).agg(F.avg("value").alias(name))

    both = steps(left, "x").join(steps(right, "y"), "step_start")
    r = F.corr("x", "y")
    return both.agg(F.count("*").alias("steps"), F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("r"))


def as_of_join(left: DataFrame, right: DataFrame, by: str, value: str, slice_us: int = SLICE_US) -> DataFrame:
    """Each left row (``by, us, id``) with the newest ``value`` of the right at or before it, by one sort of the union in time slices."""
    a = left.select(by, "us", F.lit(1).alias("side"), "id", F.lit(None).cast("double").alias("found"))
    b = right.select(by, "us", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.col(value).cast("double").alias("found"))
    both = last_known(a.unionByName(b), [by], ["us", "side", "found"], F.col("found"), "as_of", slice_us)
    return both.where("side = 1").select(by, "us", "id", "as_of")


def load_frame(events: DataFrame) -> DataFrame:
    """``metrics`` rows of the ``events`` table: name, us, value, tags, row_id, and a weight of one sample."""
    tags = F.map_from_arrays(F.array(F.lit("k"), F.lit("user_id")), F.array(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.col("user_id").cast("string")))
    return events.select(F.col("event_type").alias("name"), micros(F.col("ts")).alias("us"), "value", tags.alias("tags"), F.col("event_id").alias("row_id"), F.lit(1).alias("n"))


def with_previous(df: DataFrame, by: str, order: list[str], columns: list[str], slice_us: int = SLICE_US, ahead: str | None = None) -> DataFrame:
    """Adds ``previous``: a struct of ``columns`` of the key's row before; ``order`` begins with a number, as a time.

    Rows are windowed in time slices, so that one key fills many tasks; a slice's first row gets the last row of the
    slice before from one row a slice. ``slice_us`` is the width of a slice in that number, about a task's worth of one key.
    With ``ahead`` it is the row behind, under that name.
    """
    order_by, cell, name = F.struct(*order), F.struct(*columns), ahead or "previous"
    rows = df.withColumn("_slice", F.floor(F.col(order[0]) / slice_us))
    edge = F.min_by if ahead else F.max_by
    ends = rows.groupBy(by, "_slice").agg(edge(cell, order_by).alias("_last"))
    other = F.desc("_slice") if ahead else F.asc("_slice")
    carried = ends.select(F.col(by).alias("_key"), F.col("_slice").alias("_at"), F.lag("_last").over(W.partitionBy(by).orderBy(other)).alias("_carry"))
    rows = rows.join(carried, F.col(by).eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_at")))
    inner = (F.lead if ahead else F.lag)(cell).over(W.partitionBy(by, "_slice").orderBy(*order))
    return rows.withColumn(name, F.coalesce(inner, "_carry")).drop("_slice", "_key", "_at", "_carry")


def with_neighbours(df: DataFrame, by: list[str], order: list[str], columns: list[str], slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``previous`` and ``following``: structs of ``columns`` of the key's rows before and behind, as :func:`with_previous`, in one pass."""
    order_by, cell = F.struct(*order), F.struct(*columns)
    keys = [f"_key{i}" for i in range(len(by))]
    rows = df.withColumn("_slice", F.floor(F.col(order[0]) / slice_us))
    ends = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("_slice").alias("_at")).agg(F.min_by(cell, order_by).alias("_first"), F.max_by(cell, order_by).alias("_last"))
    slices = W.partitionBy(*keys).orderBy("_at")
    carried = ends.select(*keys, "_at", F.lag("_last").over(slices).alias("_before"), F.lead("_first").over(slices).alias("_behind"))
    same = F.col("_slice").eqNullSafe(F.col("_at"))
    for b, k in zip(by, keys, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(k))
    inner = W.partitionBy(*by, "_slice").orderBy(*order)
    rows = rows.join(carried, same).withColumns({"previous": F.coalesce(F.lag(cell).over(inner), "_before"), "following": F.coalesce(F.lead(cell).over(inner), "_behind")})
    return rows.drop("_slice", "_at", "_before", "_behind", *keys)


def container_cpu(series: DataFrame, by: str, order: list[str], slice_us: int) -> DataFrame:
    """Per cent of one CPU that a container's running counter ``cpu_ns`` used since its row before; null without time between."""
    rows = with_previous(series, by, order, ["us", "cpu_ns"], slice_us)
    elapsed = (F.col("us") - F.col("previous.us")) * 1000
    return rows.withColumn("cpu_percent", F.when(elapsed > 0, 100.0 * (F.col("cpu_ns") - F.col("previous.cpu_ns")) / elapsed)).drop("previous")


def sampled(df: DataFrame, key: Column, rate: float) -> DataFrame:
    """Rows kept with a probability, decided by the key's MD5, so that reruns and other engines keep the same ones."""
    return df.where(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32)))


def smoothed(df: DataFrame, by: str, order: list[str], alpha: float, slice_us: int) -> DataFrame:
    """Exponential smoothing of each key from its first row on, whatever ``alpha``; ``order`` begins with ``us``.

    A step maps s to alpha x + (1 - alpha) s, and steps compose: a time slice is a factor and a sum, one fold of its
    ordered values. From one row a slice each slice gets the value before it, and is then folded by itself.
    """
    import pandas as pd

    rows = sliced(df, order[0], slice_us)
    x = F.col("value").cast("double")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, x.alias("x")))), lambda e: e["x"])
    summary = {"n": F.count(x), "first": F.min_by(x, F.struct(*order)), "sum": F.aggregate(ordered, F.lit(0.0), lambda s, v: alpha * v + (1 - alpha) * s)}

    def fold(left: dict | None, row: dict) -> dict:
        return {"_seed": (1 - alpha) ** row["n"] * (row["first"] if left is None else left["_seed"]) + row["sum"]}

    rows = entering(rows, [by], summary, fold, {"_seed": "double"})

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        s, out = part["_seed"].iloc[0], []
        for x in part["value"].astype(float):
            s = x if s != s or s is None else alpha * x + (1 - alpha) * s
            out.append(s)
        return part.assign(smoothed=out)[[by, *order, "smoothed"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (by, *order)) + ", smoothed double"
    return rows.select(by, "_slice", *order, "value", "_seed").groupBy(by, "_slice").applyInPandas(walk, schema)
