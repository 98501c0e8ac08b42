"""Buffers as batch numbers: which rows a flush by size, time, priority or load would write together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_size(df: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Each key's rows in batches of ``size``; a size of 1 is an immediate flush."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1) / size))


def by_time(df: DataFrame, interval_us: int) -> DataFrame:
    """Rows of the same interval together."""
    return df.withColumn("batch", F.floor(F.col("us") / interval_us))


def by_priority(df: DataFrame, by: str, order: list[str], priority: str, urgent: int) -> DataFrame:
    """A batch ends with each row of at least ``urgent`` priority; inside a batch rows are ``rank``ed by priority."""
    w = W.partitionBy(by).orderBy(*order)
    before = F.sum((F.col(priority) >= urgent).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    rank = F.row_number().over(W.partitionBy(by, "batch").orderBy(F.desc(priority), *order))
    return df.withColumn("batch", F.coalesce(before, F.lit(0))).withColumn("rank", rank)


def adaptive(df: DataFrame, by: str, order: list[str], load: str, small: int, large: int) -> DataFrame:
    """Batches of ``large`` rows while the load is 60 or more, else of ``small``; a change of load begins another batch."""
    w = W.partitionBy(by).orderBy(*order)
    size = F.when(F.col(load) >= 60, large).otherwise(small)
    df = df.withColumn("_s", size).withColumn("_n", F.coalesce((F.lag("_s").over(w) != F.col("_s")).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(by, "_run").orderBy(*order)) - 1
    return df.withColumn("batch", F.concat_ws("-", "_run", F.floor(place / F.col("_s")).cast("string"))).drop("_s", "_n", "_run")


def kept(df: DataFrame, by: list[str], order: list[str], size: int, policy: str, priority: str | None = None) -> DataFrame:
    """What a full buffer of ``size`` holds: ``drop_oldest``, ``drop_newest`` or ``drop_lowest`` of the priority."""
    newest_first = [F.desc(c) for c in order]
    by_policy = {"drop_oldest": newest_first, "drop_newest": [F.col(c) for c in order], "drop_lowest": [F.desc(priority), *map(F.col, order)] if priority else []}
    if not by_policy.get(policy):
        raise ValueError(f"no such policy: {policy}")
    place = F.row_number().over(W.partitionBy(*by).orderBy(*by_policy[policy]))
    return df.withColumn("_p", place).where(F.col("_p") <= size).drop("_p")


def statistics(batches: DataFrame, by: list[str], capacity: int) -> DataFrame:
    """Flushes, rows, mean rows a flush, share of the capacity used, and flushes that were full."""
    b = batches.groupBy(*by, "batch").agg(F.count("*").alias("n"))
    return b.groupBy(*by).agg(F.count("*").alias("flushes"), F.sum("n").alias("rows"), F.avg("n").alias("mean_rows"), (F.avg("n") / capacity).alias("efficiency"), F.count_if(F.col("n") >= capacity).alias("full"))


def dead_letters(df: DataFrame, value: str, newest: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose text ``value`` is a number, and the ``newest`` others, as a dead-letter queue keeps them."""
    number = F.col(value).try_cast("double")
    bad = df.where(number.isNull())
    return df.where(number.isNotNull()).withColumn(value, number), bad.orderBy(*[F.desc(c) for c in order]).limit(newest)
