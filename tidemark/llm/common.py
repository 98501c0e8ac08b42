"""Helpers that several training-data operators share: shared folders, names, range cuts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Where the session names none, a local session gets a temporary one, as in tests; a cluster has to name one.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tidemark_root", None) or (known.get() if known.isDefined() else None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    context._tidemark_root = root
    if known.isEmpty():
        context.setCheckpointDir(root)
    return qualified(spark, root.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme with that of the cluster's default file system, unless that is local."""
    if ":" in path.split("/")[0]:
        return path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return path if full.startswith("file:") else full


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """A checkpoint of the rows dealt by keys, which later joins by these keys find dealt; with adaptive execution Spark forgets it, so
    that is off while the checkpoint is planned."""
    session = df.sparkSession
    adaptive = session.conf.get("spark.sql.adaptive.enabled")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.repartition(parts, *keys))
    finally:
        session.conf.set("spark.sql.adaptive.enabled", adaptive)


def unsized(df: DataFrame) -> DataFrame:
    """A checkpoint's rows without the size that was estimated for its plan, for the next round of an iteration.

    A join counts as the product of its sides, so an estimate that is carried on is squared with every round, to
    numbers of millions of digits.
    """
    session, rows = df.sparkSession, df._jdf
    return DataFrame(session._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), session)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI and the path in it; Hadoop's ``s3a`` is Arrow's ``s3``."""
    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a:") else uri
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(texts: pa.Array):
    """A column's texts one by one, so that not all of a batch are Python objects at once."""
    return (t.as_py() for t in texts)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key that a join may put into one task, and the number of such keys up to which they are broadcast.
HOT, HOT_KEYS = 50_000, 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, spread: str, most: int | None = None) -> DataFrame:
    """``left`` joined by ``key`` to ``right``, which has one row a key with the number of its rows in ``left`` as ``count``.

    Rows of a key with over ``most`` (by default ``HOT``) rows are dealt by the column ``spread`` over as many tasks as they need. Such keys
    are at most a ``most``-th of the rows; they are broadcast if they are counted as ``HOT_KEYS`` or fewer, else Spark picks the join
    (and may split it, as its other side has one row a key). ``right`` itself may be broadcast up to as many rows only: its few bytes a row
    are ten times as many in a broadcast. It is read three times: it should be a checkpoint.
    """
    most, salt, salts = most or HOT, fresh(left, "salt"), fresh(left, "salts")
    right = right.withColumn(salts, F.greatest(F.ceil(F.col(count) / most), F.lit(1)).cast("int"))
    hot = right.where(F.col(count) > most).select(key, salts)
    rows, many = right.agg(F.count("*"), F.count_if(F.col(count) > most)).first()
    hot = F.broadcast(hot) if many <= HOT_KEYS else hot
    dealt = left.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))
    return dealt.join(right if rows <= HOT_KEYS else right.hint("merge"), [key, salt]).drop(salt, salts, count)


def range_cuts(df: DataFrame, key: str, pieces: int, per_piece: int = 32) -> list[int]:
    """At most ``pieces - 1`` ascending cut points of a BIGINT key, the same for the same rows.

    They are quantiles of the ``pieces * per_piece`` keys with the smallest hashes, so a rerun cuts alike, whatever
    the order of its tasks; Spark's own range sampling depends on earlier jobs. Only the balance of the pieces rests
    on this sample. Of the keys, just those with hashes so small that some eight times as many are expected are made distinct; all
    are where repeated keys leave too few.
    """
    keys, most = df.select(F.col(key).cast("long").alias("k")).where("k is not null").withColumn("h", F.xxhash64("k")), pieces * per_piece
    share = 8 * most / max(1, keys.count())

    def smallest(some: DataFrame) -> list:
        return some.distinct().orderBy("h", "k").limit(most).collect()

    rows = smallest(keys.where(F.col("h") < F.lit(int(-(1 << 63) + share * (1 << 64))))) if share < 0.5 else []
    rows = rows if len(rows) == most else smallest(keys)
    keys = np.sort(np.array([r[0] for r in rows], dtype=np.int64))
    if not len(keys) or pieces < 2:
        return []
    return sorted({int(keys[len(keys) * i // pieces]) for i in range(1, pieces)})


def piece_of(key: Column, cuts: list[int]) -> Column:
    """The piece of each key: the number of cuts at or below it; null keys go to the last."""
    bounds = np.array(cuts, dtype=np.int64)

    @F.arrow_udf("int")
    def piece(keys: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, np.asarray(pc.fill_null(keys, 0)), side="right")
        return pa.array(np.where(np.asarray(pc.is_null(keys)), len(bounds), at), pa.int32())

    return piece(key.cast("long"))


def usable_vector(vector: Column) -> Column:
    """True for vectors that are not null, not zero, and have finite components only."""
    return (
        vector.isNotNull()
        & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    )


def steps(vector: Column, scale: int = 256) -> Column:
    """Each component as BIGINT floor(scale * component); beyond that type's range it is the nearest of its numbers."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(0).cast("long"))


def complete_vector(vector: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components; the empty and the zero vector count."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), dtype=dtype)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), dtype)
