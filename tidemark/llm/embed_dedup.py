"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, matrix, usable_vector
from .components import connected_components

BITS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small vectors from overflowing
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bitmaps(ids: np.ndarray, pivots: int) -> np.ndarray:
    """Sets of pivots, a row each, as words of 64 bits."""
    words = np.zeros((len(ids), (pivots + 63) // 64), dtype=np.uint64)
    for column in ids.T:
        words[np.arange(len(ids)), column >> 6] |= BITS[column & 63]
    return words


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(a.shape[1]):
        if a[:, i].any() and b[:, i].any():
            count += np.bitwise_count(a[:, i][:, None] & b[:, i][None, :])
    return count


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each row's smallest reachable row."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def pick_pivots(vectors: DataFrame, dim: int, count: int, apart: float = 0.8) -> np.ndarray:
    """Up to ``count`` reference points, no two with a cosine above ``apart``.

    They are taken in order from the unit vectors of the ``4 * count`` ids with the smallest hashes, a bounded sample.
    Without the distance, a large group of near copies would fill the pivots with points that its members can't order.
    """
    rows = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("id", F.lit(1)), "c").limit(4 * count).select("v").collect()
    unit = _unit(np.array([r[0] for r in rows], dtype=np.float64))
    chosen, n = np.zeros((count, dim)), 0
    for at in range(0, len(unit), 256):
        for u in unit[at : at + 256][(unit[at : at + 256] @ chosen[:n].T).max(axis=1, initial=-1) <= apart]:
            if n < count and (chosen[:n] @ u).max(initial=-1) <= apart:
                chosen[n] = u
                n += 1
    return chosen[:n]


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, nearest: int = 12, shared: int = 4, pivots: int | None = None, block: int = 2048,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``df``; links join rows of one label with cosine >= threshold.

    Equal vectors of a label become one class first, so a hot vector is a count. Each class is described by its
    ``nearest`` closest pivots, nearest first, and posted under the first ``nearest - shared + 1`` of them in pivot
    order: two classes that share ``shared`` pivots must meet in a list. A list of over ``block`` classes is split by a
    second, third and fourth pivot (of one pivot more each, so that no pair is lost) where the squares of the parts'
    lengths make up less than half of its own; a list that doesn't split so, as near copies share all pivots, is
    compared in blocks of about ``block`` classes. Shared pivots are counted from bitmaps, pairs with enough of them are
    verified by cosine in double precision, and a pair is counted only in the list of its smallest shared pivots. A
    block returns link counts and a spanning forest, not its pairs. ``pivots`` defaults to the power of two at or above
    the square root of the number of classes, 512 to 8192, which fixes the size of what is broadcast.

    A link is lost only if its two classes share fewer than ``shared`` of their ``nearest`` pivots; the README has
    measured figures.

    Rows with a null label or a vector that is null, zero or holds null or non-finite components link with nothing.
    Vectors of different lengths never link. Repeated rows count as separate vectors. A null id has a null
    component and is kept. Empty tables give empty results; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("l"), F.col(vector_col).alias("v"))
    good = rows.where(usable_vector(F.col("v")) & F.col("l").isNotNull())
    classes = checkpointed(good.groupBy("l", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("c", F.monotonically_increasing_id()))  # numbers that the checkpoint fixes
    sizes = classes.groupBy(F.size("v").alias("n")).count().collect()
    links = None
    for dim, total in sorted(map(tuple, sizes)):
        p = pivots or min(8192, max(512, 1 << math.ceil(math.log2(math.sqrt(total)))))
        part = _links(classes.where(F.size("v") == dim), pick_pivots(classes, dim, p), nearest, shared, threshold, block)
        links = part if links is None else links.union(part)
    if links is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = checkpointed(links)
    counts = links.groupBy("c").agg(F.sum("links").alias("links"))
    parts = connected_components(links, "c", "root")
    first = classes.select("c", "id").join(parts.withColumnRenamed("node", "c"), "c").groupBy("root").agg(F.min("id").alias("component"))
    known = (
        classes.select("l", "v", "c", "copies", "id")
        .join(counts, "c", "left").join(parts.withColumnRenamed("node", "c"), "c", "left").join(first, "root", "left")
        .select("l", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    linked = known.where("links > 0 or component is null")
    out = rows.join(linked, (rows.l == linked.l) & (rows.v == linked.v), "left")
    component = F.coalesce(F.when(rows.id.isNotNull(), F.col("component")), rows.id)
    return out.select(
        rows.id.alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(rows.id == component, F.lit(True)).alias("kept"),
    )


def _links(classes: DataFrame, points: np.ndarray, nearest: int, shared: int, threshold: float, block: int) -> DataFrame:
    """``c, links, root``: each class's links found in a block, weighted by copies, and a class that it reaches there."""
    spark = classes.sparkSession
    nearest = min(nearest, len(points))
    shared = min(shared, nearest)
    count = len(points)
    told = spark.sparkContext.broadcast(points.astype(np.float32))

    def describe(batches):
        p = told.value.T
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(matrix(b.column("v"))).astype(np.float32)
            top = np.concatenate([np.argsort(-(unit[i : i + 1024] @ p), axis=1, kind="stable")[:, :nearest] for i in range(0, len(unit), 1024)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, nearest, dtype=np.int32)), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("l"), b.column("v"), b.column("copies"), flat], ["c", "l", "v", "copies", "order"])

    label = classes.schema["l"].dataType.simpleString()
    vector = classes.schema["v"].dataType.simpleString()
    described = checkpointed(classes.select("c", "l", "v", "copies").mapInArrow(describe, f"c long, l {label}, v {vector}, copies long, `order` array<int>"))
    posted = described.withColumn("order", F.array_sort("order")).withColumn("key", F.array().cast("array<int>"))
    done = None
    for level in range(1, shared + 1):
        pivot = F.explode(F.filter(F.slice("order", 1, nearest - shared + level), lambda x: F.coalesce(x > F.element_at("key", -1), F.lit(True)) if level > 1 else F.lit(True)))
        posted = posted.withColumn("next", pivot).select("c", "l", "v", "copies", "order", F.concat("key", F.array("next")).alias("key"))
        if level == shared:
            break
        lists = checkpointed(_lists(posted).where(F.col("n") > block))
        if lists.isEmpty():
            break
        deeper = F.explode(F.filter(F.slice("order", 1, nearest - shared + level + 1), lambda x: x > F.element_at("key", -1)))
        parts = posted.join(lists, ["l", "key"]).select("l", "key", "n", deeper.alias("next")).groupBy("l", "key", "n", "next").count()
        split = parts.groupBy("l", "key", "n").agg(F.sum(F.col("count").cast("double") ** 2).alias("work")).where(F.col("work") * 2 < F.col("n").cast("double") ** 2).select("l", "key", F.lit(True).alias("split"))
        split = checkpointed(split)
        if split.isEmpty():
            break
        marked = posted.join(split, ["l", "key"], "left")
        whole = marked.where("split is null").drop("split")
        done = whole if done is None else done.unionByName(whole)
        posted = checkpointed(marked.where("split").drop("split"))
    posted = posted if done is None else done.unionByName(posted)
    long = _lists(posted).where(F.col("n") > block).select("l", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        posted.join(long, ["l", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    )
    compare = _comparer(count, shared, threshold)
    return dealt.groupBy("l", "key", "x", "y").applyInArrow(compare, "c long, links long, root long")


def _lists(posted: DataFrame) -> DataFrame:
    return posted.groupBy("l", "key").agg(F.count("*").alias("n"))


def _comparer(pivots: int, shared: int, threshold: float):
    def compare(group: pa.Table) -> pa.Table:
        key, x, y = (group.column(n)[0].as_py() for n in ("key", "x", "y"))
        c, own, copies = (np.asarray(group.column(n)) for n in ("c", "own", "copies"))
        order = np.argsort(c, kind="stable")
        c, own, copies = c[order], own[order], copies[order]
        unit = _unit(matrix(group.column("v")))[order]
        near = matrix(group.column("order"), np.int64)[order]
        every = _bitmaps(near, pivots)
        before = _bitmaps(np.where(near < key[-1], near, pivots), pivots + 1)  # the spare bit is cleared below
        before[:, pivots >> 6] &= ~BITS[pivots & 63]
        left = np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        found_i, found_j = [], []
        for s in range(0, len(left), 1024):
            rows = left[s : s + 1024]
            many = _shared(every[rows], every[right]) >= shared
            if x == y:
                many &= rows[:, None] < right[None, :]
            if not many.any():
                continue
            i, j = np.nonzero(many & (unit[rows] @ unit[right].T >= threshold))
            i, j = rows[i], right[j]
            first = np.bitwise_count(before[i] & before[j]).sum(axis=1) == len(key) - 1  # no smaller shared pivot but the key's
            found_i.append(i[first])
            found_j.append(j[first])
        i, j = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_i, found_j))
        links = np.bincount(i, copies[j], len(c)) + np.bincount(j, copies[i], len(c))
        root = _forest(len(c), i, j)
        has = np.flatnonzero(links)
        return pa.table({"c": pa.array(c[has]), "links": pa.array(links[has].astype(np.int64)), "root": pa.array(c[root[has]])})

    return compare
