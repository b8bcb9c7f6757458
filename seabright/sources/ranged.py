"""Recordings by byte ranges: a file is cut into ranges of equal size, each of them one task's work, and only the bytes that are asked for are fetched.

Messages follow one another, so a range must learn where its first message begins. Each range guesses it, by a place from which several messages in a row hold together, and walks the headers
to its end. The ranges of one file are then put together: where a walk did not end at the guess of the next range, the headers of that range are walked again from there. Ranges that no message begins in drop out, and so does
all that follows a place where the walk ends. The result is that of one walk from the first byte.

Spark lists the files, so folders and globs work as for any source. Ranges are read through Arrow's file systems (local, HDFS, S3, GCS); other schemes have no ranged reads here and raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.sources.common import arrow_schema

RANGE = 64 << 20
#: Messages that must hold together where a range guesses, and bytes that it looks through at once.
SURE, LOOK = 6, 1 << 20
ENDED = -1


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its name there."""
    uri = re.sub(r"^file:/*", "file:///", path)
    return fs.FileSystem.from_uri(uri) if re.match(r"^[a-z0-9+.-]+:", uri) else (fs.LocalFileSystem(), uri)


def write(path: str, data: bytes) -> None:
    """A file, in place of any of that name; its folder is made."""
    system, inner = _opened(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


class Ranged:
    """A file that is read by ranges; ``fetched`` counts the bytes."""

    def __init__(self, path: str):
        system, inner = _opened(path)
        self.file = system.open_input_file(inner)
        self.length, self.fetched = self.file.size(), 0

    def read(self, at: int, size: int) -> bytes:
        """The bytes from ``at``; fewer at the end of the file, none outside it."""
        size = min(size, self.length - at)
        if at < 0 or size <= 0:
            return b""
        self.fetched += size
        return self.file.read_at(size, at)

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place of ``what`` that begins at ``at`` or later and before ``end``; -1 if there is none."""
        while at < end:
            found = self.read(at, min(LOOK, end - at) + len(what) - 1).find(what)
            if found >= 0:
                return at + found
            at += LOOK
        return -1


class Message(Protocol):
    at: int
    end: int


class Format(Protocol):
    """How the messages of a kind of file follow one another."""

    mark: bytes

    def first(self, file: Ranged) -> int: ...

    def next(self, file: Ranged, at: int) -> Message | None:
        """The message that begins at ``at``, or at the next place the format allows; None where the walk ends."""


def walk(form: Format, file: Ranged, at: int, end: int) -> Iterator[Message]:
    """The messages that begin before ``end``."""
    while 0 <= at < end:
        message = form.next(file, at)
        if message is None or message.at >= end:
            return
        yield message
        at = message.end


def _after(form: Format, file: Ranged, at: int, end: int) -> int:
    """Where the walk from ``at`` leaves the range: the first message of those that follow begins there; ENDED if the walk ends before."""
    while at < end:
        message = form.next(file, at)
        if message is None:
            return ENDED
        at = message.end if message.at < end else message.at
    return at


def guess(form: Format, file: Ranged, begin: int, end: int) -> int:
    """The first place in the range from which messages hold together; ENDED if there is none."""
    at = begin
    while (at := file.find(form.mark, at, end)) >= 0:
        here = at
        for _ in range(SURE):
            message = form.next(file, here)
            if message is None or message.at != here:
                break
            here = message.end
            if here >= file.length:
                return at
        else:
            return at
        at += 1
    return ENDED


def _guessed(form: Format):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                file = Ranged(r["path"])
                r["at"] = form.first(file) if r["begin"] == 0 else guess(form, file, r["begin"], r["end"])
                r["to"] = _after(form, file, r["at"], r["end"]) if r["at"] != ENDED else ENDED
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("length", "begin", "end", "at", "to"))]))

    return run


def _together(form: Format) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ranges of one file, each from the place where the one before ended."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, kept, at, file = rows.sort_values("begin"), [], None, None
        for r in rows.itertuples(index=False):
            at = r.at if at is None else at
            if at == ENDED:
                break
            if at >= r.end:
                continue  # a message goes over the whole range
            kept.append((r.path, r.length, at, r.end))
            if at == r.at:
                at = r.to
            else:
                file = file or Ranged(r.path)
                at = _after(form, file, at, r.end)
        return pd.DataFrame(kept, columns=["path", "length", "at", "end"])

    return run


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def tasks_of(ranges: int, size: int, cores: int) -> int:
    """Tasks for so many ranges of so many bytes in all: one for every ``RANGE`` bytes, so that their number follows the bytes and not the ranges, and some for each core where there is less."""
    return min(10_000, max(1, min(ranges, max(4 * cores, -(-size // RANGE)))))


def spans(spark: SparkSession, path: str, form: Format, size: int = RANGE) -> DataFrame:
    """(path, length, at, end): walks from ``at`` to ``end`` that together are the walk of each file. A row is a range's work; short ranges share tasks, each of about ``RANGE`` bytes."""
    files = files_at(spark, path).where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + size, "length"))
    total = files.agg(F.sum(F.ceil(F.col("length") / size)).alias("ranges"), F.sum("length").alias("bytes")).first()
    tasks = tasks_of(total["ranges"] or 0, total["bytes"] or 0, spark.sparkContext.defaultParallelism)
    one, many = ranges.where(F.col("length") <= size), ranges.where(F.col("length") > size)
    guessed = many.repartition(tasks, "path", "begin").mapInArrow(_guessed(form), "path string, length long, begin long, end long, at long, to long")
    stitched = guessed.groupBy("path").applyInPandas(_together(form), "path string, length long, at long, end long")
    return one.select("path", "length", F.lit(0).cast("long").alias("at"), "end").unionByName(stitched).repartition(tasks, "path", "at")


def in_batches(rows: Iterator[dict], fields: pa.Schema, most_rows: int = 500, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of up to that many rows, or about as many bytes of their ``data``; missing fields are null."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        data = row.get("data")
        size += 0 if data is None else data.nbytes
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=fields)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=fields)


def rows_of_spans(frame: DataFrame, schema: str, rows: Callable[[str, Ranged, int, int], Iterator[dict]]) -> DataFrame:
    """A frame of the rows that ``rows(path, file, at, end)`` yields for each span."""
    fields = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from in_batches(rows(r["path"], Ranged(r["path"]), max(r["at"], 0), r["end"]), fields)

    return frame.mapInArrow(run, schema)


def rows_at(frame: DataFrame, schema: str, row: Callable[[str, Ranged, int], Iterator[dict]], size: int = RANGE) -> DataFrame:
    """A frame of the rows that ``row(path, file, offset)`` yields for each place of ``frame`` (path, offset). The places of one range of a file are read in one task, in order, and no other bytes are."""
    fields = arrow_schema(schema)

    def run(batches):
        name, file = None, None

        def found(batch):
            nonlocal name, file
            for r in batch.to_pylist():
                if r["path"] != name:
                    name, file = r["path"], Ranged(r["path"])
                yield from row(name, file, r["offset"])

        for batch in batches:
            yield from in_batches(found(batch), fields)

    places = frame.select("path", F.col("offset").cast("long").alias("offset")).where("path is not null and offset is not null").distinct()
    tasks = max(4 * frame.sparkSession.sparkContext.defaultParallelism, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # told, or few narrow places would be put into one task
    return places.repartition(tasks, "path", F.floor(F.col("offset") / size)).sortWithinPartitions("path", "offset").mapInArrow(run, schema)
