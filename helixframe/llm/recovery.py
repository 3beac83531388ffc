"""Cutting lineage with files that outlive executors, and joins whose side is broadcast behind a check of its size."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids (of 8 bytes) that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Spark's setting by which a query's shuffle files go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> None:
    """Have a checkpoint folder: the cluster's, as spark.checkpoint.dir names it; one of our own only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Have tables that are made and stored inside leave no shuffle files: Spark then removes them when the query that wrote them
    ends, and not some time after nothing refers to them any more (`release`), which on a busy driver may be too late."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to any more, so that phases don't add up on disk."""
    for _ in range(2):  # Python's references go first, and a moment later
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of df whose key is among ids.column (stored, distinct): by broadcast if those are few, else by a shuffle."""
    side = ids.select(ids[column].alias("_only"))
    if side.count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    return df.join(side, df[key] == side["_only"], "left_semi")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared checkpoint folder and read again."""
    shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
