"""Helpers shared by the corpus operators: tables, shared-storage materialisation, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most bytes of an Arrow batch sent to Python, where the session does not say otherwise: 10 000 long texts would fill hundreds of MB.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8000000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop-compatible path works."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seabright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/seabright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize``d frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def release_memory() -> None:
    """Give what a task has freed back to the system, so that reused Python workers do not keep the most they ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps the memory for later tasks
        pass


def finite_vector(vector: Column) -> Column:
    """True for arrays without null, NaN or infinite components; null arrays give false."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )


class TwoGenerations(dict):
    """A bounded cache: when the young half is full it becomes the old half, and what is still asked for comes back.

    It never holds more than twice ``limit`` entries, and no result depends on what it holds.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def unknown(self, keys: set) -> set:
        """The keys that neither half holds; the others are young afterwards, until more than ``limit`` are put."""
        missing = keys - self.keys()
        old = self.old
        for key in [k for k in missing if k in old]:
            missing.discard(key)
            self[key] = old[key]
        return missing
