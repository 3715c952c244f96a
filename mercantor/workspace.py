"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "mercantor.workspace"


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def folder(spark: SparkSession) -> str:
    """The session's own folder for intermediate tables, which goes when the session's JVM ends.

    It lies in ``spark.checkpoint.dir``, which all executors reach.  Only a local session without that setting
    (a test) gets a temporary folder; on a cluster the setting is required.
    """
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (None if set_dir.isEmpty() else set_dir.get())
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mercantor-")
        spark.sparkContext.setCheckpointDir(base)
    mark = f"{_FOLDER}.{spark.sparkContext.applicationId}"
    found = spark.conf.get(mark, None)
    if found is None:
        found = f"{base}/mercantor-{uuid.uuid4().hex}"
        fs, there = _file_system(spark, found)
        fs.mkdirs(there)
        fs.deleteOnExit(there)
        spark.conf.set(mark, found)
    return found


def fresh_path(spark: SparkSession, what: str = "table") -> str:
    """A new name in the session's folder."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the session's shared folder and returns a frame that reads it.

    The files survive lost executors, unlike a local checkpoint.  `drop` deletes them once nothing reads them.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mx_path = path
    return out


def drop(*kept: DataFrame) -> None:
    """Deletes tables that `keep` wrote, and lets Spark delete the shuffle files of finished steps now."""
    for df in kept:
        fs, there = _file_system(df.sparkSession, df._mx_path)
        fs.delete(there, True)
    release(kept[0])


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of finished steps now, instead of when the driver next collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
