"""Metrics derived from wide samples: melting, shares, threshold findings, totals by kind, component merges, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import guarded

#: Warning and critical bounds of resource use in per cent (fixed values).
RESOURCE_BOUNDS = {"cpu": (75.0, 90.0), "memory": (80.0, 95.0), "disk": (85.0, 95.0), "swap": (50.0, 80.0)}


def melted(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Long ``keys, name, value`` rows of a wide sample; ``names`` maps columns to metric names; nulls are left out."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, n in names.items()])
    return df.select(*keys, F.inline(cells)).where("value IS NOT NULL")


def percent(part: Column, total: Column) -> Column:
    return 100 * guarded(part.cast("double"), total.cast("double"))


def findings(long: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows of ``name, value`` that reach a bound, with ``level`` warning or critical."""
    level = F.lit(None).cast("string")
    for name, (warning, critical) in (bounds or RESOURCE_BOUNDS).items():
        level = F.when((F.col("name") == name) & (F.col("value") >= critical), "critical").when((F.col("name") == name) & (F.col("value") >= warning), "warning").otherwise(level)
    return long.withColumn("level", level).where("level IS NOT NULL")


def pool_issues(df: DataFrame) -> DataFrame:
    """Adds ``issues``, in order, and ``health`` of thread pools from their ``saturation``, ``utilisation``, ``failures`` and ``wait_ms``.

    A column ``rejections`` counts too if there is one.
    """
    def issue(c: str, warning: float | None, critical: float) -> Column:
        out = F.when(F.col(c) >= critical, f"{c}:critical")
        return out if warning is None else out.when(F.col(c) >= warning, f"{c}:warning")

    found = [issue("saturation", 0.7, 0.9), issue("utilisation", None, 0.9).when(F.col("utilisation") < 0.2, "utilisation:low"), issue("failures", 0.05, 0.1)]
    if "rejections" in df.columns:
        found.append(issue("rejections", 0.01, 0.05))
    issues = F.array_compact(F.array(*found, issue("wait_ms", 1000, 5000)))
    worst = F.when(F.exists("issues", lambda i: F.endswith(i, F.lit("critical"))), "unhealthy").when(F.size("issues") > 0, "degraded").otherwise("healthy")
    return df.withColumn("issues", issues).withColumn("health", worst)


def totals(df: DataFrame, by: list[str], used: str, total: str, name: str) -> DataFrame:
    """Sums, mean and greatest use in per cent of volumes, and the volume that has it (ties: the first name)."""
    use = percent(F.col(used), F.col(total))
    return df.groupBy(*by).agg(F.sum(used).alias("used"), F.sum(total).alias("total"), F.avg(use).alias("mean_use"), F.max(use).alias("max_use"), F.min_by(name, F.struct(-use, F.col(name))).alias("fullest"))


def counts_by_kind(df: DataFrame, by: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """A column of counts for each kind, and their total, in one pass without a pivot's extra job."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count("*").alias("total"))


def merged_components(df: DataFrame, component: str, order: list[str]) -> DataFrame:
    """``component.key`` metrics of all components, the last written value winning, plus ``component.metric_count``."""
    last = df.groupBy(component, "key").agg(F.max_by("value", F.struct(*order)).alias("value"))
    rows = last.select(F.concat_ws(".", component, "key").alias("name"), "value")
    counts = last.groupBy(component).agg(F.count("*").cast("double").alias("value"))
    return rows.union(counts.select(F.concat(F.col(component), F.lit(".metric_count")).alias("name"), "value"))


def ratios(df: DataFrame, by: list[str], ok: str, size: str) -> DataFrame:
    """Success and failure shares (1 and 0 for no rows), and the mean size of a batch."""
    n = F.count("*")
    good = F.count_if(F.col(ok))
    return df.groupBy(*by).agg(n.alias("attempts"), F.when(n > 0, good / n).otherwise(1.0).alias("success_rate"), F.when(n > 0, (n - good) / n).otherwise(0.0).alias("failure_rate"), guarded(F.sum(size).cast("double"), n).alias("mean_size"))


def log_storage(logs: DataFrame, hours_by_level: dict[str, int], as_of_us: int) -> DataFrame:
    """Rows and bytes to keep and to delete of each level, by its hours of retention."""
    hours = F.lit(None).cast("long")
    for level, h in hours_by_level.items():
        hours = F.when(F.col("level") == level, F.lit(h)).otherwise(hours)
    keep = F.col("us") >= F.lit(as_of_us) - F.coalesce(hours, F.lit(0)) * 3_600_000_000
    return logs.groupBy("level").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("expired"), F.sum(F.when(keep, F.col("bytes")).otherwise(0)).alias("kept_bytes"))


def coerced(value: Column) -> dict[str, Column]:
    """A text value as double (0.0 if it is none), whole number (cut off) and text with six decimals."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return {"as_double": number, "as_long": number.cast("long"), "as_text": F.format_string("%.6f", number)}


def analysed(df: DataFrame, by: list[str], function, schema: str) -> DataFrame:
    """A user's function from one group's pandas rows to pandas rows, for analyses that no aggregate expresses."""
    return df.groupBy(*by).applyInPandas(function, schema)
