"""Collectors as a data source: a user's function makes the rows of each partition, wherever Spark runs it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CollectorSource(DataSource):
    """``spark.read.format("collector").option("function", "module:name").option("partitions", n).schema(...).load()``.

    The function takes the partition's number, the number of partitions and the options, and yields tuples of the schema.
    """

    @classmethod
    def name(cls) -> str:
        return "collector"

    def schema(self) -> str:
        return "name string, us long, value double"

    def reader(self, schema) -> DataSourceReader:
        return CollectorReader(self.options)


class CollectorReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("partitions", 1)))]

    def read(self, partition: InputPartition):
        module, _, name = self.options["function"].partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.value, int(self.options.get("partitions", 1)), self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CollectorSource)


def collect(spark: SparkSession, function: str, partitions: int = 1, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("collector").option("function", function).option("partitions", partitions).options(**options).load()


def ramp(partition: int, partitions: int, options: dict):
    """A collector to try out: ``rows`` samples of a ramp, dealt to the partitions."""
    for i in range(partition, int(options.get("rows", 10)), partitions):
        yield "ramp", i * 1_000_000, float(i)
