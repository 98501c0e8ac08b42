"""Whitening of embeddings: covariance by Chan's merging of partitions, eigenvectors on the driver, a second pass that verifies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_vector, matrix, shared_dir, steps

#: Eigenvalues up to this share of the largest count as zero: such a component has no scale to divide by.
FLAT = 1e-12


@dataclass
class Moments:
    """Of some vectors: their number, exact sums by dimension, and the scatter about their mean."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of integer rows, centred exactly; what might leave 64 bits is taken over Python's integers."""
        n = len(x)
        if np.abs(x.astype(float)).max(initial=0) * n >= 2.0**61:
            x = x.astype(object)
        sums = x.sum(axis=0)
        centred = ((n * x - sums) / n).astype(float)
        return cls(n, [int(s) for s in sums], centred.T @ centred)

    @classmethod
    def plain(cls, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        mean = y.mean(axis=0)
        return len(y), mean, (y - mean).T @ (y - mean)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, plus that of the two means, whose exact difference counts."""
        n, both = self.n + other.n, self.n * other.n
        gap = np.array([(b * self.n - a * other.n) / both for a, b in zip(self.sums, other.sums, strict=True)])
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], scatter)


def _joined(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Chan's formula for rows of doubles."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))


def moments(fit: DataFrame) -> Moments:
    """Of the vectors ``x`` of a table that isn't empty: one row a partition, merged pairwise in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (Moments.of(matrix(b.column(0), np.int64)) for b in batches if b.num_rows)
        total = None
        for part in parts:
            total = total.merge(part) if total else part
        if total:
            sums = ",".join(map(str, total.sums))
            yield pa.RecordBatch.from_pydict({"n": pa.array([total.n], pa.int64()), "sums": [sums], "scatter": pa.array([total.scatter.tobytes()], pa.binary())})

    def read(row) -> Moments:
        sums = [int(s) for s in row.sums.split(",")]
        return Moments(row.n, sums, np.frombuffer(row.scatter).reshape(len(sums), -1))

    return fit.select("x").mapInArrow(partial, "n long, sums string, scatter binary").rdd.map(read).treeReduce(Moments.merge)


@dataclass
class Whitening:
    """Exact sums of the fitted vectors, and the leading components with their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    flat: np.ndarray
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (x - np.array([s / self.n for s in self.sums])) @ self.vectors / np.sqrt(self.values)
        y[:, self.flat] = np.nan
        return y

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where a sum exceeds a BIGINT."""
        reach = self.n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, self.sums), default=0)
        if reach * reach * x.shape[1] < 2.0**62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def solve(m: Moments, components: int) -> Whitening:
    """Unit eigenvectors of the covariance by falling eigenvalue; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(m.scatter)) / m.n
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    flat = values <= max(values.max(initial=0), 0) * FLAT
    return Whitening(m.n, m.sums, vectors, values, values / trace if trace > 0 else np.full(len(order), np.nan), flat)


def verify(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity, over components with variance."""
    own = ~model.flat
    if not own.any():
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = Moments.plain(model.project(matrix(b.column(0), np.int64))[:, own])
                total = _joined(total, part) if total else part
        if total:
            yield pa.RecordBatch.from_pydict({"n": pa.array([total[0]], pa.int64()), "mean": pa.array([total[1].tobytes()], pa.binary()), "scatter": pa.array([total[2].tobytes()], pa.binary())})

    rows = fit.select("x").mapInArrow(partial, "n long, mean binary, scatter binary").rdd
    n, _, scatter = rows.map(lambda r: (r.n, np.frombuffer(r.mean), np.frombuffer(r.scatter).reshape(own.sum(), -1))).treeReduce(_joined)
    return float(np.abs(scatter / n - np.eye(own.sum())).max())


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each remaining row and leading component.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped; of vectors of different lengths, those of
    the length that most rows have remain (of equally many, the longest). Components become integer steps
    (:func:`common.steps`). The fit list holds each distinct vector once, however many rows repeat it. ``whitened`` is null for
    components without variance (all of one distinct vector's), ``explained`` and ``identity_error`` if none has any, ``deviation``
    where it exceeds a BIGINT. Null and repeated ids are rows like others; empty tables give empty results; other columns are ignored.
    """
    spark = df.sparkSession
    x, id_ = steps(F.col(vector_col), scale), F.col(id_col).alias("vec_id")
    rows = df.where(complete_vector(F.col(vector_col)) & (F.size(vector_col) > 0)).select(id_, x.alias("x"))
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths[0]["k"])
    folder = shared_dir(spark, "distinct-vectors")
    rows.select("x").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    model = solve(moments(fit), components)
    model.identity_error = verify(fit, model)

    @F.arrow_udf("struct<deviation: bigint, y: array<double>>")
    def projected(vectors: pa.Array) -> pa.Array:
        x = matrix(vectors, np.int64)
        if not len(x):
            return pa.array([], pa.struct({"deviation": pa.int64(), "y": pa.list_(pa.float64())}))
        y = model.project(x)
        flat = pa.array(y.ravel(), pa.float64(), mask=np.isnan(y).ravel())
        offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
        return pa.StructArray.from_arrays([pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["deviation", "y"])

    def known(v: float | None):
        return F.lit(None if v is None or np.isnan(v) else float(v)).cast("double")

    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), known(s).alias("explained"), F.lit(i).alias("at")) for i, s in enumerate(model.shares)])
    return (
        rows.select("vec_id", projected("x").alias("p")).select("vec_id", "p", F.explode(each).alias("c"))
        .select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "p.deviation", F.col("p.y")[F.col("c.at")].alias("whitened"), "c.explained", known(model.identity_error).alias("identity_error"))
    )
