"""Mixing sources to target weights along a curriculum, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh, partitions, shared_dir

WEIGHTS = (3, 1, 2)
#: A source's share of the demand at the start and the end of training, before normalising; repeated like the weights.
SCHEDULE = ((1.0, 3.0), (1.0, 1.0), (3.0, 1.0))


def size_of(text: Column) -> Column:
    """Words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: ``share`` of all sizes dealt by weight, none above ``cap`` times its size.

    The excess of capped sources goes to the others by weight until none is above its cap. In order of cap over weight,
    the capped sources are a prefix, so one window gives the level at which the rest is dealt. It runs over one row a
    source, which doesn't grow with the documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, here = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    total = F.sum("source_size").over(W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(here))
    s = s.withColumn("fits", F.col("most") / F.col("weight") > F.col("level"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "level"))).over(W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    return s.withColumn("target", F.coalesce(F.least("most", level * F.col("weight")), F.col("most"))).select("source", "source_size", "weight", "target")


def position(at: Column, start: Column, end: Column) -> Column:
    """The training time in [0, 1] at which a source with a linear schedule has used the fraction ``at`` of its target.

    The demand up to t is the integral of the schedule, (start t + (end - start) t^2 / 2) / ((start + end) / 2); this
    is its inverse.
    """
    return at * (start + end) / (start + F.sqrt(start * start + (end - start) * at * (start + end)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, key: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies, position, position_2`` for each row, and its ``key`` if one is named.

    A source is read in the order of its ids' MD5, again from its start if its target is larger than its size, until its
    target is reached; ``taken`` are the words of a row in that stretch (the last document may be cut), ``copies`` how
    often the stretch begins the row (0, 1 or 2), and the positions are the training times of those beginnings. The
    order inside a source is a running sum in two steps: over the sums of many buckets of the MD5, and inside a bucket,
    so a hot source is spread over all tasks.

    Null texts have size 0, null sources form one source, repeated rows count each, rows with null ids come first, by size.
    Ties of id and size are between equal rows, or go by ``key``, a number that no two rows share. Empty tables give empty results; other columns are ignored.
    """
    digest = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    rows = checkpointed(df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), digest.alias("turn"), (F.col(key) if key else F.lit(0).cast("long")).alias("row"),
    ))
    buckets = 16 ** 3
    bucket = F.coalesce(F.conv(F.substring("turn", 1, 3), 16, 10).cast("int"), F.lit(0))
    # rows without an id share one turn, in which they stand by size
    rows = rows.withColumns({"bucket": bucket, "sub": F.when(F.col("doc_id").isNull(), F.col("size")).otherwise(-1)})
    sums = rows.groupBy("source", "bucket", "sub").agg(F.sum("size").alias("s"))
    bases = sums.select("source", "bucket", "sub", (F.sum("s").over(W.partitionBy("source").orderBy(F.desc(F.col("sub") >= 0), "bucket", "sub")) - F.col("s")).alias("base"))
    goals = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), share, cap)
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(SCHEDULE) + 1
    goals = goals.select("*", *[F.element_at(F.array(*[F.lit(s[i]) for s in SCHEDULE]), turn).alias(n) for i, n in enumerate(("w0", "w1"))])
    known = bases.join(goals.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g").withColumnsRenamed({"source": "s", "bucket": "b", "sub": "e"})
    inner = W.partitionBy("source", "bucket", "sub").orderBy("turn", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("sub") == F.col("e")))
    start, goal, size, whole = F.col("base") + F.col("inner"), F.floor("target"), F.col("size"), F.col("source_size")
    zero = F.lit(0).cast("long")

    def part(shift: Column) -> Column:
        return F.greatest(zero, F.least(size, goal - shift - start))

    begins = [(size > 0) & (start < goal), (size > 0) & (start + whole < goal)]
    times = [F.when(b, position((start + whole * i) / F.col("target"), F.col("w0"), F.col("w1"))) for i, b in enumerate(begins)]
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (part(zero) + part(whole)).alias("taken"),
        (begins[0].cast("int") + begins[1].cast("int")).alias("copies"), times[0].alias("position"), times[1].alias("position_2"), *([F.col("row").alias(key)] if key else []),
    )


def in_order(df: DataFrame, at: str = "position", id_col: str = "doc_id") -> DataFrame:
    """Range-sorted by training time, rows without one last; the id keeps those of equal times apart."""
    key = (F.col(at).asc_nulls_last(), F.col(id_col))
    return df.repartitionByRange(partitions(df.sparkSession), *key).sortWithinPartitions(*key)


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as the mix takes them, whole, range-sorted by training time; a row comes 0, 1 or 2 times.

    Rows are numbered in a table in the shared folder and taken by that number, so each row has its own decision, whether its
    id is null, repeated or neither; each source's words come within a document of its target.
    """
    spark, at, key, times_ = df.sparkSession, fresh(df, "position"), fresh(df, "row"), fresh(df, "times")
    folder = shared_dir(spark, "mixed")
    df.withColumn(key, F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    plan = mix(rows, id_col, text_col, source_col, key=key).where("copies > 0")
    taken = rows.join(plan.select(key, F.array_compact(F.array("position", "position_2")).alias(times_)), key).withColumn(at, F.explode(times_))
    return in_order(taken, at, id_col).select(*[F.col(f"`{c}`") for c in df.columns])
