"""Tables of alert and aggregation rules: from text, checked, and the standard ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import config as C
from .aggregates import percentiles
from .alerts import SEVERITIES

#: Operators that a rule may name, and what stands for each.
OPERATORS = {">": ">", ">=": ">=", "<": "<", "<=": "<=", "==": "==", "=": "==", "!=": "!=", "<>": "!=", "": ">"}
KINDS = ("threshold", "rate", "anomaly", "absent")
#: (source, prefix, interval in us, percentiles, rate, outliers, deviations) of the standard rules (fixed values).
STANDARD = (
    ("response_time", "response_time_agg", 60_000_000, [0.5, 0.9, 0.95, 0.99], False, True, 3.0),
    ("request_count", "request_count_agg", 60_000_000, [0.5, 0.9, 0.95, 0.99], True, False, 3.0),
    ("error_count", "error_count_agg", 60_000_000, [0.5, 0.9, 0.95, 0.99], True, True, 2.0),
    ("cpu_usage", "cpu_usage_agg", 60_000_000, [0.5, 0.9, 0.95, 0.99], False, True, 3.0),
    ("memory_usage", "memory_usage_agg", 60_000_000, [0.5, 0.9, 0.95, 0.99], False, True, 3.0),
)
RULE = "source_metric string, prefix string, interval_us long, points array<double>, rate boolean, outliers boolean, k double"


def defined(texts: DataFrame) -> DataFrame:
    """Typed rules from text columns ``rule, metric, kind, op, threshold, severity, hold, repeat, enabled``, with ``problem``.

    Empty kinds, operators and severities stand for threshold, ``>`` and warning. A rule has a problem if it lacks a name
    or a metric, names an unknown kind, operator or severity, or repeats the name of one before it (in order of ``line``).
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    kind = F.when(text("kind") == "", "threshold").otherwise(F.col("kind"))
    severity = F.when(text("severity") == "", "warning").otherwise(F.col("severity"))
    op = F
    for said, meant in OPERATORS.items():
        op = op.when(text("op") == said, meant)
    typed = texts.select(
        "line", F.col("rule"), F.col("metric"), kind.alias("kind"), op.otherwise(F.lit(None)).alias("op"), C.number(F.col("threshold"), 0.0).alias("threshold"), severity.alias("severity"),
        C.duration_us(F.col("hold"), 0).alias("hold_us"), C.duration_us(F.col("repeat"), 300_000_000).alias("repeat_us"), C.boolean(F.col("enabled"), True).alias("enabled"))
    again = F.row_number().over(W.partitionBy("rule").orderBy("line")) > 1
    problem = (
        F.when(text("rule") == "", "no name").when(text("metric") == "", "no metric").when(~F.col("kind").isin(*KINDS), "unknown kind")
        .when((F.col("kind") == "threshold") & F.col("op").isNull(), "unknown operator").when(~F.col("severity").isin(*SEVERITIES), "unknown severity").when(again, "repeated name"))
    return typed.withColumn("problem", problem)


def standard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STANDARD, RULE)


def checked(rules: DataFrame) -> DataFrame:
    """Aggregation rules with ``problem``: an empty source or prefix, no positive interval, or a source that has a rule (by ``line``)."""
    again = F.row_number().over(W.partitionBy("source_metric").orderBy("line")) > 1
    return rules.withColumn("problem", F.when(F.col("source_metric") == "", "no source").when(F.col("prefix") == "", "no prefix").when(F.col("interval_us") <= 0, "no interval").when(again, "repeated source"))


def aggregated(df: DataFrame, rules: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """``metric, window_start, value`` by rule and its own interval: moments, percentiles, and where asked for ``.rate`` and ``.outlier_count``.

    Outliers of a window lie more than the rule's deviations off its mean; the rows of rules that count them meet their window's moments
    again, so no window is held together. The few rules meet the rows by metric name.
    """
    window = (F.floor(F.col("us") / F.col("interval_us")) * F.col("interval_us")).cast("long")
    rows = df.join(rules, df["name"] == rules["source_metric"]).withColumn("window_start", window)
    q, x, keys = percentiles(F.col("value"), points), F.col("value").cast("double"), ["prefix", "window_start"]
    wide = rows.groupBy(*keys, "interval_us", "rate", "outliers", "k").agg(
        F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"), F.count(x).cast("double").alias("count"),
        *[q[i].alias(f"p{round(p * 100)}") for i, p in enumerate(points)])
    moments = wide.where("outliers").select(*keys, "mean", "stddev")
    far = rows.where("outliers").select(*keys, x.alias("x"), "k").join(moments, keys).groupBy(*keys).agg(F.count_if(F.abs(F.col("x") - F.col("mean")) > F.col("k") * F.col("stddev")).cast("double").alias("_far"))
    wide = wide.join(far, keys, "left").withColumns({"_rate": F.when(F.col("rate"), F.col("count") / (F.col("interval_us") / 1e6)), "_out": F.when(F.col("outliers"), F.col("_far"))})
    names = {n: n for n in ("mean", "min", "max", "stddev", "count", *[f"p{round(p * 100)}" for p in points])} | {"rate": "_rate", "outlier_count": "_out"}
    cells = F.array(*[F.struct(F.concat(F.col("prefix"), F.lit(f".{n}")).alias("metric"), F.col(c).alias("value")) for n, c in names.items()])
    return wide.select("window_start", F.inline(cells)).where("value IS NOT NULL").select("metric", "window_start", "value")
