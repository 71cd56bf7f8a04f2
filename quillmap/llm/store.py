"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, run_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the table replaces the shuffle files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_stash_path", None):
            delete(df.sparkSession, path)


def small_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Bound the Arrow batches that Python workers hold, whatever the texts' lengths.

    Plans read the setting when they run, which is after the operator returns; so it stays set in the session.
    """
    spark.conf.set(_BATCH_BYTES, str(megabytes << 20))


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a narrow table at hand, marked for broadcast if it has at most ``rows`` rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


class Shipped:
    """A broadcast object whose class travels with it, so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.packed.value)
