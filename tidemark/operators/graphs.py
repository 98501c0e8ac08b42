"""Dependency graphs, health and traces."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folders import checkpointed
from .scans import SLICE_US

STATUS = ("healthy", "degraded", "unhealthy")


def reachable(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``start, reached, depth`` for all pairs along edges, with the smallest depth, by a recursive query with set semantics.

    Each round joins the newest pairs to the edges and keeps those that are new; it ends when none is, cycles included.
    """
    step = edges.select(F.col(source).alias("start"), F.col(target).alias("reached")).distinct()
    found = step.withColumn("depth", F.lit(1))
    newest = found
    for depth in itertools.count(2):
        joined = newest.select("start", F.col("reached").alias("via")).join(step.select(F.col("start").alias("via"), "reached"), "via")
        newest = checkpointed(joined.select("start", "reached").distinct().join(found, ["start", "reached"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            return found
        found = found.union(newest)


def failure_impact(edges: DataFrame) -> DataFrame:
    """For each dependency, all that depend on it, directly or not; edges are ``dependent, dependency``."""
    return reachable(edges, "dependency", "dependent").select(F.col("start").alias("failed"), F.col("reached").alias("affected"), "depth")


def would_cycle(edges: DataFrame, dependent: str, dependency: str) -> bool:
    """Whether an edge would close a cycle: the new dependency already depends on the dependent, or they are equal."""
    known = reachable(edges, "dependent", "dependency")
    return dependent == dependency or not known.where((F.col("start") == dependency) & (F.col("reached") == dependent)).isEmpty()


def topological(edges: DataFrame) -> DataFrame:
    """``node, level``: the longest path below each node, and ``place`` in an order that puts dependencies first.

    Nodes of a level are in order of their names. A cycle raises an error. Ranges of the order are numbered side by side,
    each from the sizes of those before it.
    """
    nodes = edges.select(F.col("dependent").alias("node")).union(edges.select(F.col("dependency").alias("node"))).distinct()
    level = nodes.withColumn("level", F.lit(0))
    newest, depth, total = nodes, 0, nodes.count()
    while not newest.isEmpty():
        depth += 1
        if depth > total:
            raise ValueError("the graph has a cycle")
        newest = checkpointed(newest.join(edges, F.col("node") == F.col("dependency")).select(F.col("dependent").alias("node")).distinct())
        level = level.union(newest.withColumn("level", F.lit(depth)))
    best = level.groupBy("node").agg(F.max("level").alias("level"))
    ordered = checkpointed(best.orderBy("level", "node").withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    starts, before = [], 0
    for r in ordered.groupBy("_range").count().orderBy("_range").collect():  # one row a partition
        starts.append((r["_range"], before))
        before += r["count"]
    starts = ordered.sparkSession.createDataFrame(starts, "_range long, _start long")
    return ordered.join(F.broadcast(starts), "_range").select("node", "level", (F.col("_start") + F.col("_at") + 1).cast("int").alias("place"))


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUS)), status)


def rolled_up(checks: DataFrame, by: list[str], need_all: bool = True) -> DataFrame:
    """The worst status of each group if all are needed, else the best; with counts."""
    pick = F.max if need_all else F.min
    return checks.groupBy(*by).agg(
        F.element_at(F.array(*map(F.lit, STATUS)), pick(status_rank(F.col("status"))).cast("int")).alias("status"), F.count("*").alias("checks"), F.count_if(F.col("status") == "unhealthy").alias("unhealthy"))


def with_dependencies(checks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each check's own status, made ``degraded`` at least if a direct dependency is unhealthy."""
    bad = edges.join(checks.where("status = 'unhealthy'").select(F.col("name").alias("dependency")), "dependency").select(F.col("dependent").alias("name")).distinct().withColumn("bad", F.lit(True))
    return checks.join(bad, "name", "left").withColumn("status", F.when(F.col("bad") & (F.col("status") == "healthy"), "degraded").otherwise(F.col("status"))).drop("bad")


def fleet_healthy(services: DataFrame) -> DataFrame:
    """Whether over half the services are at their normal level; an empty fleet is healthy."""
    return services.agg(F.coalesce(F.avg((F.col("level") == "normal").cast("int")) > 0.5, F.lit(True)).alias("healthy"))


def trace_tree(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, depth`` from root spans (without a parent in the trace) down.

    Pointer doubling: in each round the spans that have no root yet ask the one their pointer names, which doubles the pointer's
    reach, so a trace of depth d takes log2(d) rounds. A span comes once for each way to a root, so repeated span ids multiply; spans
    on a circle of parents, or below one, have no root and are left out.
    """
    known = spans.select("trace_id", F.col("span_id").alias("up")).distinct().withColumn("_there", F.lit(True))
    state = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("up")).join(known, ["trace_id", "up"], "left")
    state = checkpointed(state.select("trace_id", "span_id", F.when(F.col("_there"), F.col("up")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).alias("depth")))
    done, asking = state.where("up IS NULL"), state.where("up IS NOT NULL")
    while True:
        far = done.unionByName(asking).select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = asking.join(far, ["trace_id", "up"]).select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = checkpointed(state)
        found = state.where("up IS NULL")
        if found.isEmpty():  # depths have no gaps, so what a round doesn't resolve any of are circles
            return done.select("trace_id", "span_id", "depth")
        done, asking = done.unionByName(found), state.where("up IS NOT NULL")


def capped_spans(spans: DataFrame, order: list[str], most_spans: int = 1000, most_traces: int = 10_000) -> DataFrame:
    """What a bounded store of traces holds: the traces that began last, and each one's first spans."""
    starts = spans.groupBy("trace_id").agg(F.min("start_us").alias("_start")).orderBy(F.desc("_start"), F.desc("trace_id")).limit(most_traces).select("trace_id")
    kept = spans.join(F.broadcast(starts), "trace_id", "left_semi")  # ``most_traces`` rows
    return kept.withColumn("_r", F.row_number().over(W.partitionBy("trace_id").orderBy(*order))).where(F.col("_r") <= most_spans).drop("_r")


def trace(spans: DataFrame, trace_id) -> DataFrame:
    """One trace's spans; the filter reaches the scan."""
    return spans.where(F.col("trace_id") == trace_id)


def trace_summary(spans: DataFrame) -> DataFrame:
    """Spans, errors, duration and longest span of each trace."""
    took = F.col("end_us") - F.col("start_us")
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.count_if(F.col("error")).alias("errors"), (F.max("end_us") - F.min("start_us")).alias("duration_us"), F.max_by("span_id", F.struct(took, (-F.col("span_id")).alias("s"))).alias("slowest_span"))


def self_time(spans: DataFrame) -> DataFrame:
    """Each span's duration less that of its direct children."""
    took = F.col("end_us") - F.col("start_us")
    children = spans.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum(took).alias("children_us"))
    return spans.join(children, ["trace_id", "span_id"], "left").select("trace_id", "span_id", took.alias("duration_us"), (took - F.coalesce("children_us", F.lit(0))).alias("self_us"))


def export_batches(spans: DataFrame, order: list[str], by: str, size: int = 100, queue: int = 2048) -> DataFrame:
    """The newest ``queue`` spans of each ``by`` with their batch number, oldest first."""
    slice_ = F.floor(F.col(order[0]) / SLICE_US)  # the rows of the newest slices that hold the queue are put in order, not all rows
    cells = spans.groupBy(F.col(by).alias("_by"), slice_.alias("_at")).agg(F.count("*").alias("_n"))
    newer = F.coalesce(F.sum("_n").over(W.partitionBy("_by").orderBy(F.desc_nulls_last("_at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    oldest = cells.withColumn("_newer", newer).where(F.col("_newer") < queue).groupBy("_by").agg(F.min("_at").alias("_oldest"), F.max(F.col("_at").isNull()).alias("_all"))
    spans = spans.join(oldest, F.col(by).eqNullSafe(F.col("_by"))).where(F.col("_all") | (slice_ >= F.col("_oldest"))).drop("_by", "_oldest", "_all")
    newest = spans.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= queue).drop("_r")
    return newest.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1) / size))
