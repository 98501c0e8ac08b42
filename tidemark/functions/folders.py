"""The folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or what was given to ``setCheckpointDir``; a local session that names none gets a temporary folder, a cluster is an error."""
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
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()
