"""Results that are kept under the fingerprint of the settings that made them: mosaics, resampled layers, renderings.

A result is written aside and renamed to its key when it is whole, with its settings beside it, so that what can be seen is complete and says what it is. Whoever asks again reads it; the newest few are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seabright.operators.contacts import fingerprint
from seabright.sources.files import Files

KEEP = 4
SETTINGS = "_settings.json"  # hidden from Spark's readers


def _text(settings: object) -> str:
    return json.dumps(settings, separators=(",", ":"), sort_keys=True)


def found(spark: SparkSession, folder: str, settings: object) -> DataFrame | None:
    """The result that was made with these settings, if it is there whole; one whose own settings differ is not it."""
    files, path = Files(spark), f"{folder}/{fingerprint(settings)}"
    if not files.exists(f"{path}/_SUCCESS") or not files.exists(f"{path}/{SETTINGS}") or files.read(f"{path}/{SETTINGS}") != _text(settings):
        return None
    return spark.read.parquet(path)


def kept(spark: SparkSession, folder: str, settings: object, make: Callable[[], DataFrame], keep: int = KEEP) -> DataFrame:
    """The result of ``make`` for these settings: read where it is kept, else made, published and read; then all but the ``keep`` newest of the folder are deleted.

    Two that make it at once both succeed; the first to publish is kept.
    """
    have = found(spark, folder, settings)
    if have is not None:
        return have
    files, key = Files(spark), fingerprint(settings)
    aside, path = f"{folder}/.{key}-{uuid.uuid4().hex}", f"{folder}/{key}"
    make().write.parquet(aside)
    files.write(f"{aside}/{SETTINGS}", _text(settings))
    if files.exists(path) and found(spark, folder, settings) is None:
        files.delete(path)  # half a result, or of other settings
    try:
        files.rename(aside, path)
    except Exception:
        files.delete(aside)
        if found(spark, folder, settings) is None:
            raise
    prune(spark, folder, keep, key)
    return spark.read.parquet(path)


def prune(spark: SparkSession, folder: str, keep: int, *always: str) -> list[str]:
    """Delete all but the ``keep`` newest results, by time of change and then name; those in ``always`` stay and count. The names deleted."""
    files = Files(spark)
    rest = sorted((f for f in files.folders(folder) if f[1] not in always), reverse=True)
    gone = [name for _, name in rest[max(0, keep - len(always)) :]]
    for name in gone:
        files.delete(f"{folder}/{name}")
    return gone
