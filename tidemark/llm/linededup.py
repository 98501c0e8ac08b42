"""Boilerplate lines by site-relative frequency, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

RATIO, LEAST = 0.1, 3
#: Where a source of many pages stands for a host: no line but one reaches a tenth of such a source.
SOURCE_RATIO = 0.01
#: Up to this many boilerplate lines (24 bytes each) are broadcast; beyond it the pages are shuffled by host.
BROADCAST_LINES = 200_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``host, h1, h2, pages, total``: lines on more than ``ratio`` of a host's pages, and on ``least`` pages at least.

    A line counts once a page, blank lines never; it is known by two 64-bit hashes. Both counts are aggregated before
    they are shuffled, so a hot host or line is one row a task. A host has at most its mean number of lines a page
    divided by ``ratio`` such lines.
    """
    pages = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    line = F.explode(F.array_distinct(lines_of(F.col("text"))))
    lines = pages.select("host", line.alias("line")).where(F.trim("line") != "")
    counts = lines.groupBy("host", *hashes("line")).agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    totals = totals.withColumnRenamed("host", "t")
    return counts.join(totals, F.col("host").eqNullSafe(F.col("t"))).where(F.col("pages") > ratio * F.col("total")).drop("t")


def hashes(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def drop_boilerplate(
    df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``df`` without its hosts' boilerplate lines; ``counts`` names two columns for lines before and lines dropped.

    Each host's lines to drop become one array, bounded as in :func:`boilerplate`; joined to the pages it filters their
    lines in place, so no text is split into rows or put together again. The arrays are counted first: few are
    broadcast, many are joined by host, where a hot host's pages can be split between tasks. Null texts stay null and have no lines, empty
    texts have one; a page whose lines all go has an empty text; null hosts form one host; repeated rows are pages of
    their own. Every row is kept, whatever other columns there are.
    """
    bad, host, kept = fresh(df, "bad"), fresh(df, "host"), fresh(df, "kept")
    found = checkpointed(boilerplate(df, host_col, text_col, ratio, least))
    few = found.count() <= BROADCAST_LINES
    lists = found.groupBy(F.col("host").alias(host)).agg(F.collect_list(F.struct("h1", "h2")).alias(bad))
    lists = F.broadcast(lists) if few else lists
    text = F.col(text_col)
    keep = F.filter(lines_of(text), lambda x: ~F.array_contains(F.col(bad), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))
    out = df.join(lists, F.col(host_col).eqNullSafe(F.col(host)), "left").withColumn(kept, F.when(F.col(bad).isNotNull(), keep))
    lines = F.coalesce(F.size(lines_of(text)), F.lit(0)) if counts else None
    new = F.when(F.col(kept).isNull(), text).otherwise(F.array_join(F.col(kept), "\n"))
    extra = []
    if counts:
        before = F.when(text.isNull(), 0).otherwise(lines).cast("long")
        dropped = F.when(F.col(kept).isNull(), 0).otherwise(before - F.size(F.col(kept))).cast("long")
        extra = [before.alias(counts[0]), dropped.alias(counts[1])]
    return out.select(*[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in df.columns], *extra)
