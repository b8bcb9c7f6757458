"""PNG images as a binary column: mosaic tiles and waterfall rows, without an imaging library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit image (rows, columns[, channels]) as PNG, in the fewest channels that lose nothing."""
    image = np.ascontiguousarray(image, np.uint8)
    if image.ndim == 2:
        image = image[:, :, None]
    if image.shape[2] in (2, 4) and (image[:, :, -1] == 255).all():
        image = image[:, :, :-1]
    if image.shape[2] >= 3 and (image[:, :, 0] == image[:, :, 1]).all() and (image[:, :, 1] == image[:, :, 2]).all():
        image = np.concatenate([image[:, :, :1], image[:, :, 3:]], axis=2)
    height, width, channels = image.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")


def tiles(cells: DataFrame) -> DataFrame:
    """tx, ty, png of the tiles that hold any of ``cells`` (gx, gy, r, g, b); uncovered cells are clear. A tile is at most 65 536 cells."""

    def paint(part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((TILE, TILE, 4), np.uint8)
        y, x = (part["gy"] % TILE).to_numpy(), (part["gx"] % TILE).to_numpy()
        image[y, x, :3] = part[["r", "g", "b"]].to_numpy(np.uint8)
        image[y, x, 3] = 255
        return pd.DataFrame({"tx": part["tx"].iloc[:1], "ty": part["ty"].iloc[:1], "png": [encode(image)]})

    placed = cells.select("gx", "gy", "r", "g", "b", F.floor(F.col("gx") / TILE).alias("tx"), F.floor(F.col("gy") / TILE).alias("ty"))
    return placed.groupBy("tx", "ty").applyInPandas(paint, "tx long, ty long, png binary")


def rows_image(rows: DataFrame, block: int = 1024) -> DataFrame:
    """dataset, block, png of waterfall rows (dataset, row, pixels of one width), ``block`` rows to an image."""

    def paint(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        image = np.stack([np.frombuffer(p, np.uint8) for p in part["pixels"]])
        return pd.DataFrame({"dataset": part["dataset"].iloc[:1], "block": part["block"].iloc[:1], "png": [encode(image)]})

    kind = rows.schema["dataset"].dataType.simpleString()
    return rows.withColumn("block", F.floor(F.col("row") / block)).groupBy("dataset", "block").applyInPandas(paint, f"dataset {kind}, block long, png binary")
