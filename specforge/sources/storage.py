"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="specforge-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, written as Parquet to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of checkpointed() frames that are read no more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
