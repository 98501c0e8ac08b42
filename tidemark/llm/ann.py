"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, matrix, usable_vector


def lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample; starts from evenly spaced rows, and an empty cluster keeps its centroid."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def centre_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(centre_distances(x[i : i + 4096], centres), axis=1) for i in range(0, max(1, len(x)), 4096)])


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of the sum of two distances until they hold ``wanted`` entries: a heap over two sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, width = first[a].tolist(), second[b].tolist(), len(second)
    a, b, sizes = a.tolist(), b.tolist(), counts.tolist()
    heap, cells, got = [(x[0] + y[0], 0, 0)], [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if sizes[cell]:
            cells.append(cell)
            got += sizes[cell]
        if j + 1 < width:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def needed(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: list[int]) -> list[int]:
    """For each cell of ``wanted``, the entries that a walk must ask for to reach it."""
    walk = traverse(first, second, counts, int(counts.sum()))
    before = np.zeros(len(counts), dtype=np.int64)
    before[walk] = np.cumsum(counts[walk]) - counts[walk]
    return (before[wanted] + 1).tolist()


def nearest_rows(q: np.ndarray, q_id: np.ndarray, e: np.ndarray, e_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query row, entry row, distance`` of candidates that include each query's ``k`` nearest entries of other ids."""
    found = [[], [], []]
    square, step = (e * e).sum(1), max(1, (1 << 22) // max(1, len(e)))
    for s in range(0, len(q), step):
        part = q[s : s + step]
        rough = square[None, :] - 2 * part @ e.T
        rough[e_id[None, :] == q_id[s : s + step, None]] = np.inf
        if len(e) > k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
            limit = limit + 1e-9 * (1 + np.abs(limit) + (part * part).sum(1))
        else:
            limit = np.full(len(part), np.finfo(float).max)
        i, j = np.nonzero((rough <= limit[:, None]) & (rough < np.inf))
        for out, x in zip(found, (i + s, j, np.sqrt(((e[j] - part[i]) ** 2).sum(1))), strict=True):
            out.append(x)
    i, j, d = (np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, (int, int, float), strict=True))
    return i, j, d


def best_rows(i: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` nearest, ties to smaller ids."""
    order = np.lexsort((ids, d, i))
    own = i[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < k]


def nearest_neighbours(
    df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int | None = None,
    recall: float = 0.95, probe: float | None = None, sample: int = 20_000, tried: int = 128, block: int | None = None, query_block: int = 16_384,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` selects, its ``k`` nearest other rows found.

    Each half of the vectors is quantised by ``centroids`` centres (default: the power of two nearest to the fourth root
    of the rows, 64 to 256) fitted on at most ``sample`` vectors with the smallest id hashes; every row is indexed under
    its pair of centres. A query walks the pairs by summed distance with a heap until they hold a number of entries;
    then the entries of those cells are reranked by Euclidean distance of the original vectors in double precision.

    That number is measured, at every size alike: for the ``tried`` queries with the smallest id hashes the true
    neighbours are found among all rows, and it is the least that reaches the fraction ``recall`` of them. ``probe``, a
    fraction of all entries, takes its place if given.

    Cells lie in blocks of about ``block`` entries (a larger cell fills several; by default a 128th of the rows, 512 to
    262,144). Queries are dealt by their nearest cells into blocks of ``query_block``, and a block of entries goes only
    to the blocks of queries that visit it; two blocks are compared at a time, which gives ``k`` rows for each query. Of
    equal vectors only the ``k + 1`` with the smallest ids are entries: no more can be among the nearest.

    Vectors that are null, zero, hold null or non-finite components, or differ in length from the most common length
    take no part, nor do rows with null ids. Ties go to the smaller id; rows with a query's own id are not its
    candidates; a repeated query row gives one answer. Empty tables give empty results; other columns are ignored.
    """
    spark = df.sparkSession
    good = df.where(usable_vector(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    answer = "query_id long, rank int, vec_id long, score double"
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], answer)
    good = good.where(F.size("v") == lengths["n"])
    good = checkpointed(good.groupBy("id", "v").agg(F.max("q").alias("q")))  # the caps below count distinct rows
    smallest = good.select("id", "v", "q").orderBy(F.xxhash64("id"), "id")
    fit = np.array([r[0] for r in smallest.limit(sample).select("v").collect()], dtype=np.float64)
    probes = smallest.where("q").limit(tried).select("id", "v").collect()  # a bounded number of queries
    if not probes:
        return spark.createDataFrame([], answer)
    centroids = centroids or min(256, max(64, 1 << round(math.log2(max(1, lengths["count"])) / 4)))
    half = (lengths["n"] + 1) // 2
    parts = [(slice(0, half), lloyd(fit[:, :half], centroids)), (slice(half, None), lloyd(fit[:, half:], centroids))]
    width = len(parts[1][1])

    def index(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                one, two = (nearest_centre(x[:, s], c) for s, c in parts)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array((one * width + two).astype(np.int32))], ["id", "v", "cell"])

    kind = good.schema["v"].dataType.simpleString()
    entries = good.select("id", "v", F.row_number().over(W.partitionBy("v").orderBy("id")).alias("n")).where(F.col("n") <= k + 1)
    entries = checkpointed(entries.select("id", "v").mapInArrow(index, f"id long, v {kind}, cell int"))
    counts = np.zeros(len(parts[0][1]) * width, dtype=np.int64)
    for cell, n in entries.groupBy("cell").count().collect():  # at most centroids squared rows
        counts[cell] = n
    if probe is None:
        wanted = _measured(entries, probes, parts, counts, k, recall)
    else:
        wanted = int(np.ceil(probe * counts.sum()))
    block = block or int(min(262_144, max(512, counts.sum() // 128)))
    splits = np.maximum(1, -(-counts // block))
    whole = np.where(splits > 1, 0, counts)
    first = np.cumsum(whole) // block  # small cells share blocks
    base = first[-1] + 1 + np.concatenate([[0], np.cumsum(np.where(splits > 1, splits, 0))[:-1]])
    asked = good.where("q").select("id", "v")
    near = checkpointed(asked.mapInArrow(index, f"id long, v {kind}, cell int"))
    held = np.zeros(len(counts), dtype=np.int64)
    for cell, n in near.groupBy("cell").count().collect():
        held[cell] = n
    q_splits = np.maximum(1, -(-held // query_block))
    q_first = np.cumsum(np.where(q_splits > 1, 0, held)) // query_block
    q_base = q_first[-1] + 1 + np.concatenate([[0], np.cumsum(np.where(q_splits > 1, q_splits, 0))[:-1]])

    def dealt(ids: np.ndarray, cell: np.ndarray, splits, base, first) -> np.ndarray:
        """The block of each row: its cell's, or by its id one of those that a large cell fills."""
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return np.where(splits[cell] > 1, base[cell] + (mixed % splits[cell].astype(np.uint64)).astype(np.int64), first[cell])

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            d = [centre_distances(x[:, s], c) for s, c in parts]
            mine = dealt(np.asarray(b.column("id")), np.asarray(b.column("cell")), q_splits, q_base, q_first)
            rows, at, cells = [], [], []
            for i in range(len(x)):
                seen = np.array(traverse(d[0][i], d[1][i], counts, wanted))
                large = splits[seen] > 1
                own = [np.where(large, base[seen], first[seen])] + [base[c] + np.arange(1, splits[c]) for c in seen[large]]
                which = [seen] + [np.full(splits[c] - 1, c) for c in seen[large]]
                own, which = np.concatenate(own), np.concatenate(which)
                order = np.argsort(own, kind="stable")
                own, which = own[order], which[order]
                cut = np.flatnonzero(np.diff(own)) + 1
                at += own[np.concatenate([[0], cut])].tolist()
                cells += np.split(which.astype(np.int32), cut)
                rows += [i] * (len(cut) + 1)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(taken), b.column("v").take(taken), pa.array(at, pa.int64()), pa.array(mine).take(taken), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cells)))],
                ["id", "v", "eb", "qb", "cells"],
            )

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dealt(np.asarray(b.column("id")), np.asarray(b.column("cell")), splits, base, first))], ["id", "v", "cell", "eb"])

    visits = checkpointed(near.repartition(F.xxhash64("id")).mapInArrow(visit, f"id long, v {kind}, eb long, qb long, cells array<int>"))
    placed = entries.mapInArrow(place, f"id long, v {kind}, cell int, eb long")
    visited = visits.select(F.col("eb").alias("at"), F.col("qb").alias("by")).distinct()
    placed = placed.join(visited, F.col("eb") == F.col("at")).select("id", "v", "cell", "at", "by")

    def rerank(ask: pa.Table, have: pa.Table) -> pa.Table:
        q, e = matrix(ask.column("v")), matrix(have.column("v"))
        i = j = np.zeros(0, dtype=np.int64)
        d, q_id, e_id = np.zeros(0), np.asarray(ask.column("id")), np.asarray(have.column("id"))
        if len(q) and len(e):
            cell, lists = np.asarray(have.column("cell")), ask.column("cells").combine_chunks()
            by_cell = np.argsort(cell, kind="stable")
            ends = np.flatnonzero(np.diff(cell[by_cell], append=-1)) + 1
            ask_cell, ask_row = np.asarray(lists.flatten()), np.repeat(np.arange(len(q)), np.asarray(lists.value_lengths()))
            found = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                rows = by_cell[a:b]
                some = ask_row[ask_cell == cell[rows[0]]]
                if len(some):
                    x, y, z = nearest_rows(q[some], q_id[some], e[rows], e_id[rows], k)
                    found.append((some[x], rows[y], z))
            if found:
                i, j, d = (np.concatenate(f) for f in zip(*found, strict=True))
                kept = best_rows(i, e_id[j], d, k)
                i, j, d = i[kept], j[kept], d[kept]
        return pa.table({"query_id": pa.array(q_id[i], pa.int64()), "vec_id": pa.array(e_id[j], pa.int64()), "score": pa.array(d, pa.float64())})

    found = visits.groupBy("eb", "qb").cogroup(placed.groupBy("at", "by")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _measured(entries: DataFrame, probes: list, parts: list, counts: np.ndarray, k: int, recall: float) -> int:
    """The least number of entries to ask for that reaches ``recall`` of the true neighbours of the queries ``probes``."""
    q_id, q = np.array([r[0] for r in probes]), np.array([r[1] for r in probes], dtype=np.float64)

    def nearest(batches):
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            i, j, d = nearest_rows(q, q_id, matrix(b.column("v")), ids := np.asarray(b.column("id")), k)
            new = [i, ids[j], d, np.asarray(b.column("cell"))[j]]
            best = new if best is None else [np.concatenate(x) for x in zip(best, new, strict=True)]
            kept = best_rows(best[0], best[1], best[2], k)
            best = [x[kept] for x in best]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best[0].astype(np.int32), best[1], best[2], best[3].astype(np.int32))], ["q", "id", "d", "cell"])

    found = entries.mapInArrow(nearest, "q int, id long, d double, cell int").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k)
    cells: dict[int, list[int]] = {}
    for i, cell in found.select("q", "cell").collect():  # k rows a query at most
        cells.setdefault(i, []).append(cell)
    d = [centre_distances(q[:, s], c) for s, c in parts]
    asked = sorted(n for i, c in cells.items() for n in needed(d[0][i], d[1][i], counts, c))
    return asked[max(0, math.ceil(recall * len(asked)) - 1)] if asked else 1
