"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import checkpointed, spread_join, unsized


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """``left`` with ``m`` of its node ``a``; of up to ``HOT`` rows none can be too many for a task, so they need no dealing."""
    return spread_join(left, right, "a", "n", "b") if rows > common.HOT else left.join(right.drop("n"), "a")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of ``links``; root is the component's smallest node.

    Large-star and small-star rounds, each two aggregations with map-side combine and joins that deal out the many links
    of a contracted root, repeat until the edges stop changing, in a number of rounds that grows with the logarithm of
    the diameter. Each round ends in a reliable checkpoint. Rows with a null end and links of a node with itself don't
    count as links.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = unsized(checkpointed(edges))
    seen = _state(edges)
    while seen[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _joined(both.where("b > a"), least, seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined(large, least, seen[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = unsized(checkpointed(small.select("e.a", "e.b").where("a <> b").distinct()))
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
