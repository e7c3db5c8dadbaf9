"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a folder of our own, in local mode alone: on a cluster no other machine sees it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/quernel/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> str:
    """Writes df to a new path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it again: cuts lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))
