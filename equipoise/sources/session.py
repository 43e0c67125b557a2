"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make one only for an in-process local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="equipoise-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`checkpoint`, in compressed columns: a fraction of the disk for a large table.  Partitions do not stay."""
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):  # what parquet does not hold
        return checkpoint(df)
    path = scratch_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def training_table(df: DataFrame, key: Sequence[str], partitions: int = 0) -> Iterator[DataFrame]:
    """``df`` cached for repeated passes, in ``partitions`` partitions by key (0: as it comes).

    Tree learners draw the bins of a feature per partition, so a model follows the number given here and not the cluster.
    """
    cached = (df.repartition(partitions, *key) if partitions else df).persist()
    try:
        cached.count()
        yield cached
    finally:
        cached.unpersist()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
