"""Whole files to rows: Spark lists and reads them, so any path that Spark reads works; one file is one task's work at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The Arrow type of each Spark type that sources use.
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark schema in words."""
    return pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema)])


def rows_of(frame: DataFrame, schema: str, items: Callable[[pa.RecordBatch], Iterator[tuple]], rows: Callable[..., Iterator[dict]], at_once: int = 500) -> DataFrame:
    """A frame of the rows that ``rows(*item)`` yields for each item of each batch of ``frame``; missing fields are null."""
    fields = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for item in items(batch):
                held: list[dict] = []
                for row in rows(*item):
                    held.append(row)
                    if len(held) == at_once:
                        yield pa.RecordBatch.from_pylist(held, schema=fields)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=fields)

    return frame.mapInArrow(run, schema)


def rows_of_files(spark: SparkSession, path: str, schema: str, rows: Callable[[str, bytes], Iterator[dict]], at_once: int = 500) -> DataFrame:
    """A frame of the rows that ``rows(path, content)`` yields for each file; missing fields are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return rows_of(files, schema, lambda batch: ((n, c.as_py()) for n, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)), rows, at_once)
