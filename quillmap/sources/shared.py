"""The folder that the driver and all executors share, and tables of one application in it."""

from __future__ import annotations

import atexit
import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one JVM."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            path = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark.sparkContext, path)


def _delete(sc, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def run_folder(spark: SparkSession) -> str:
    """The application's folder for its tables; results read some of them, so they go when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/quillmap/{sc.applicationId}"
    if getattr(sc, "_quillmap_folder", None) != path:
        sc._quillmap_folder = path
        atexit.register(lambda: sc._jsc is not None and _delete(sc, path))
    return path
