"""Stores of metrics and snapshots behind one interface: files of several formats, JDBC, key-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc", "jdbc")
COMPRESSION = ("none", "gzip", "lz4", "zstd", "snappy")


class Store:
    """Appends to and reads a table in a folder (any URI that Spark reads) or a database."""

    def __init__(self, spark: SparkSession, target: str, kind: str = "parquet", compression: str | None = None, **options: str):
        if kind not in FORMATS or compression not in (None, *COMPRESSION):
            raise ValueError(f"no such store: {kind}, {compression}")
        self.spark, self.target, self.kind, self.options = spark, target, kind, dict(options)
        if compression and kind != "jdbc":
            self.options["compression"] = compression
        if kind == "csv":
            self.options.setdefault("header", "true")

    def append(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        writer = df.write.mode("append").format(self.kind).options(**self.options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.option("dbtable", self.target).save() if self.kind == "jdbc" else writer.save(self.target)

    def read(self, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.format(self.kind).options(**self.options)
        if schema and self.kind in ("json", "csv", "parquet", "orc"):
            reader = reader.schema(schema)
        return reader.option("dbtable", self.target).load() if self.kind == "jdbc" else reader.load(self.target)


def create_store(spark: SparkSession, config: dict) -> Store:
    return Store(spark, config["target"], config.get("kind", "parquet"), config.get("compression"), **config.get("options", {}))


def snapshots(df: DataFrame, source: str, time: str, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots of each source, numbered from the oldest kept, 0 first."""
    rank = F.dense_rank().over(W.partitionBy(source).orderBy(F.desc(time)))
    kept = df.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r")
    return kept.withColumn("snapshot", F.dense_rank().over(W.partitionBy(source).orderBy(time)) - 1)


def snapshot_range(df: DataFrame, start: int, count: int) -> DataFrame:
    return df.where(F.col("snapshot").between(start, start + count - 1))


def capped_series(metrics: DataFrame, most: int) -> DataFrame:
    """Metrics of the ``most`` names that were first seen (ties by name), found on one row a name."""
    first = metrics.groupBy("name").agg(F.min(F.struct("us", "row_id")).alias("seen"))
    names = first.orderBy("seen", "name").limit(most).select("name")
    return metrics.join(names, "name", "left_semi")


def collected(*sources: DataFrame) -> DataFrame:
    """All collectors' rows in one table; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
