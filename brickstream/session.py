"""Session helpers: table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it.

    Only where the session names none and all executors are on this machine (tests) a
    temporary folder is made, set and removed at the end; on a cluster that is an error, as
    every executor would write to its own disk.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="brickstream-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written once as a parquet table in the shared folder and read back.

    Cheaper than a checkpoint for wide rows: columnar, prunable and with statistics.  The
    tables stay until :func:`release`, so a later action on the same plan, also after the
    loss of an executor, finds them.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that :func:`written` has made; to be called when no result that reads them is needed any more."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
