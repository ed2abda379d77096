"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a temporary one on one machine, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skerry-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/skerry/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again: loops over it keep a short plan, and lost executors cost no more than a read."""
    path, sc = folder(df.sparkSession), df.sparkSession.sparkContext
    df.write.parquet(path)
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path)
