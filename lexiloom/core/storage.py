"""Shared storage for intermediate tables.

The folder comes from ``spark.checkpoint.dir`` of the running session.  Only
where that is unset and the master is local (tests, a laptop) a private folder
is made and registered as the checkpoint folder; on a cluster an unset folder is
an error, as a machine-local one would be lost with its machine.

Tables of one application lie in one folder below it, which :func:`clear`
deletes; at the end of the program that is done for the caller.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_seen: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder of the session, setting one only if unset and local."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        local = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, local, True)
        sc.setCheckpointDir(f"file://{local}")
        current = sc.getCheckpointDir()
    return str(current).rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexiloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; results that still read them are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _clear_at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is the cluster's to clean then
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    This cuts the lineage: the files survive the loss of any executor, and every
    later use reads them instead of computing ``df`` again.  With
    ``drop_shuffles`` the shuffle files of the write are deleted at its end; else
    they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _seen:
        _seen.add(spark.sparkContext.applicationId)
        atexit.register(_clear_at_end, spark)
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true" if drop_shuffles else before)
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
