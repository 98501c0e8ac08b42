"""Centroid clustering by delta Lloyd: assignments and sums are kept, a round works on what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_vector, matrix, shared_dir, steps

#: Integer components beyond this count as this, so that squared distances of 64 of them fit a BIGINT.
REACH = 1 << 27
#: Vectors that are compared at once.
BLOCK = 4096


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in doubles where every sum stays below 2^53, else in 64-bit integers."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4.0 * most * most * x.shape[1] < 2.0**53:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids numbered ``changed`` moved; ties go to the smaller number.

    A vector whose owner stayed can only be won by a changed centroid, so it is compared with those alone. A vector
    whose owner moved (or that has none, -1) is compared with all.
    """
    owner, distance = owner.copy(), distance.copy()
    moved = np.isin(owner, changed) | (owner < 0)
    for rows, against in ((np.flatnonzero(moved), np.arange(len(centroids))), (np.flatnonzero(~moved), changed)):
        if not len(rows) or not len(against):
            continue
        d = distances(x[rows], centroids[against])
        best = d.argmin(axis=1)  # the first of equals, so the smallest number
        nearest, number = d[np.arange(len(rows)), best], against[best]
        wins = (owner[rows] < 0) | np.isin(owner[rows], changed) | (nearest < distance[rows]) | ((nearest == distance[rows]) & (number < owner[rows]))
        owner[rows[wins]], distance[rows[wins]] = number[wins], nearest[wins]
    return owner, distance


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state ``vec_id, x, owner, before, distance`` after one round; ``before`` is the owner that a vector comes with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = matrix(b.column("x"), np.int64)
                before = b.column("owner")
                owner, distance = reassign(x, np.asarray(before, np.int64), np.asarray(b.column("distance"), np.int64), centroids, changed)
                columns = [b.column("vec_id"), b.column("x"), pa.array(owner, pa.int32()), before, pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "owner", "before", "distance"])

    return state.select("vec_id", "x", "owner", "distance").mapInArrow(run, f"vec_id {dict(state.dtypes)['vec_id']}, x array<int>, owner int, before int, distance long")


def transfers(state: DataFrame, dimensions: int) -> list[tuple[int, list[int]]]:
    """``(centroid, [count, sum of each dimension])``, signed: what vectors that changed owner take from one and give to another.

    The sums combine before the shuffle, so each task sends one row a centroid.
    """
    sides = F.explode(F.array(F.struct(F.col("owner").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")))).alias("t")
    rows = state.where("owner <> before").select("x", sides).where("t.c >= 0").select("t.c", "t.sign", *[F.col("x")[i].cast("long").alias(f"x{i}") for i in range(dimensions)])
    sums = rows.groupBy("c").agg(F.sum("sign"), *[F.sum(F.col("sign") * F.col(f"x{i}")) for i in range(dimensions)])
    return [(r[0], list(r[1:])) for r in sums.collect()]  # a row a centroid at most


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each kept vector.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite, as integer steps (:func:`common.steps`; beyond
    2^27 they count as that). The ``k`` vectors with the smallest SHA-256 of ``seed`` and id are the first centroids (repeated ids
    by their vectors; null ids can't be centroids). A round assigns, by :func:`reassign`, and moves every centroid with vectors to the exact
    floor of their mean; sums change only by the signed transfers of vectors that changed owner. Rounds end early once no
    centroid moves, which gives the same. Each round's state is a table in the shared folder, that of the round before last
    is removed. With fewer vectors than ``k`` there are as many centroids; without one that has an id, the cluster and what
    follows from it are null. Inertias beyond a BIGINT are null; empty tables give empty results; other columns are ignored.
    """
    spark = df.sparkSession
    clipped = F.transform(steps(F.col(vector_col), scale), lambda c: F.greatest(F.least(c, F.lit(REACH)), F.lit(-REACH)).cast("int"))
    folder = shared_dir(spark, "clusters")
    vectors = df.where(complete_vector(F.col(vector_col)) & (F.size(vector_col) == dimensions)).select(F.col(id_col).alias("vec_id"), clipped.alias("x"))
    vectors.withColumns({"owner": F.lit(-1), "before": F.lit(-1), "distance": F.lit(0).cast("long")}).write.parquet(f"{folder}/0")
    state = spark.read.parquet(f"{folder}/0")
    hashed = state.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    first = [r.x for r in hashed.orderBy("h", "x").limit(k).collect()]
    if not first:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return state.select("vec_id", *nothing)
    centroids = np.array(first, dtype=np.int64)
    sums, counts = [[0] * dimensions for _ in first], [0] * len(first)
    changed = np.arange(len(first))
    for turn in range(1, rounds + 2):
        assigned(state, centroids, changed).write.parquet(f"{folder}/{turn}")
        state = spark.read.parquet(f"{folder}/{turn}")
        if turn > 1:
            _remove(spark, f"{folder}/{turn - 2}")
        if turn > rounds:
            break
        for c, (count, *moved) in transfers(state, dimensions):
            counts[c] += count
            sums[c] = [a + b for a, b in zip(sums[c], moved, strict=True)]
        means = [[s // n for s in total] if n else old.tolist() for total, n, old in zip(sums, counts, centroids, strict=True)]
        changed = np.flatnonzero((np.array(means, dtype=np.int64) != centroids).any(axis=1))
        centroids = np.array(means, dtype=np.int64)
        if not len(changed):
            break
    inertia = {r[0]: r[1] for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(c, _long(inertia.get(c, 0)), _long(sum(inertia.values())), name) for c, name in enumerate(names)]
    clusters = spark.createDataFrame(known, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(clusters), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(v) -> int | None:
    return int(v) if v < 1 << 63 else None


def _remove(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
