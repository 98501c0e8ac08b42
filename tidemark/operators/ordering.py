"""Orders, tops and bounded buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` most frequent values (ties by value) with their counts."""
    return df.groupBy(by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), by).limit(k)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def priority_buffer(df: DataFrame, by: list[str], priority: str, seq: str, size: int) -> DataFrame:
    """What a bounded buffer holds that drops the lowest priority, newest first, with each row's ``place``."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(priority), seq))
    return df.withColumn("place", place).where(F.col("place") <= size)


def active_collectors(df: DataFrame, by: str, priority: str, name: str, cpu: str) -> DataFrame:
    """Collectors that stay at a mean CPU use: all up to 40, 75 % up to 60, half up to 80, else 20 %; 3, 2 and 1 at least."""
    w = W.partitionBy(by)
    n, use = F.count("*").over(w), F.avg(cpu).over(w)
    keep = F.when(use > 80, F.greatest(F.lit(1), F.floor(n * 0.2))).when(use > 60, F.greatest(F.lit(2), F.floor(n * 0.5))).when(use > 40, F.greatest(F.lit(3), F.floor(n * 0.75))).otherwise(n)
    place = F.row_number().over(w.orderBy(F.desc(priority), name))
    return df.withColumn("place", place).withColumn("_k", keep).where("place <= _k").drop("_k")
