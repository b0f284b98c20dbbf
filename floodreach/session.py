"""Session settings and the one way this package cuts lineage."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: as named by the cluster in ``spark.checkpoint.dir``, else the context's checkpoint folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    return path.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def measured_joins(spark: SparkSession) -> None:
    """Let this session broadcast a join side only once its size has been measured by a shuffle.

    Estimates start from the size of files. They know neither of exploded rows nor of packed columns, and a table
    that takes 1 MB on disk may become gigabytes in the driver and in every task."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives lost executors, has a short plan and, unlike a cached frame, an exact size on
    disk, so the planner's broadcast decision is taken on a measured number."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` wrote for this application. Call it once results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
