"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seabright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once, sorted by ``by`` within its files, and read back: what is used several times is computed once, and lost executors cost no more than their part."""
    path = f"{shared_dir(df.sparkSession)}/seabright/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*by) if by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
