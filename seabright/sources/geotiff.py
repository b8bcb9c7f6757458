"""GeoTIFF grids by block: a row is a strip or tile of the first image with its samples as one array, and only its bytes are fetched.

Classic and Big TIFF in either byte order; uncompressed, LZW, Deflate and PackBits; predictors 1 to 3; palette, grey (white or black is zero), RGB and RGBA of 8 to 64
bits. Separate planes, JPEG and other colour models are refused by name. The directory of a file is read once, where its blocks are listed; strips without compression are cut further, by rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.sources.ranged import Ranged, files_at

# Bytes and letter of each field type.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, one code early."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, None
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(start)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(entry)
        last = entry
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


#: Samples of a row at most; larger blocks are several rows.
MOST_SAMPLES = 1 << 20


class GeoTiff:
    """The first image of a file that is read by ranges."""

    def __init__(self, file: Ranged):
        self.file = file
        head = file.read(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF")
        self.order = "<" if head[:2] == b"II" else ">"
        version = struct.unpack_from(self.order + "H", head, 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = version == 43
        self.entries = self._directory(struct.unpack_from(self.order + ("Q" if self.big else "I"), head, 8 if self.big else 4)[0])
        one = lambda tag, default: (self.values(tag) or [default])[0]
        self.width, self.height, self.bands = one(256, 0), one(257, 0), one(277, 1)
        bits, self.photometric = self.values(258) or [1], one(262, 1)
        kind = one(339, 1)
        if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or kind not in (1, 2, 3) or (kind, bits[0]) in ((3, 8), (3, 16)):
            raise ValueError(f"samples of {bits} bits are not supported")
        if one(284, 1) != 1 and self.bands > 1:
            raise ValueError("separate planes are not supported")
        if self.photometric in (5, 6):
            raise ValueError("CMYK and YCbCr are not supported")
        self.dtype = np.dtype(f"{self.order}{'?uif'[kind]}{bits[0] // 8}")
        self.compression, self.predictor = one(259, 1), one(317, 1)
        if self.compression not in (1, 5, 8, 32946, 32773):
            raise ValueError(f"compression {self.compression} is not supported")
        if self.predictor not in (1, 2, 3):
            raise ValueError(f"predictor {self.predictor} is not supported")
        self.tiled = 322 in self.entries
        self.block_w, self.block_h = (one(322, 0), one(323, 0)) if self.tiled else (self.width, min(max(one(278, self.height), 1), self.height))
        colours = self.values(320)
        self.palette = None if colours is None else (np.array(colours[: len(colours) // 3 * 3]).reshape(3, -1).T >> 8).astype(np.uint8)
        nodata = self.values(42113)
        self.nodata = float(nodata) if nodata and nodata.strip() else None
        self.affine = self._affine()
        self.epsg = self._epsg()

    def _directory(self, at: int) -> dict[int, tuple[str, int, int]]:
        """Of each tag the letter, number and place of its values; these are fetched when they are asked for."""
        count, entry, head = ("Q", 20, 8) if self.big else ("H", 12, 2)
        n = struct.unpack(self.order + count, self.file.read(at, head))[0]
        raw, tags = self.file.read(at + head, n * entry), {}
        for o in range(0, len(raw) // entry * entry, entry):
            tag, kind = struct.unpack_from(self.order + "HH", raw, o)
            if kind in TYPES:
                size, letter = TYPES[kind]
                number = struct.unpack_from(self.order + ("Q" if self.big else "I"), raw, o + 4)[0]
                inside = number * size <= (8 if self.big else 4)
                place = o + (12 if self.big else 8)
                tags[tag] = letter, number, at + head + place if inside else struct.unpack_from(self.order + ("Q" if self.big else "I"), raw, place)[0]
        return tags

    def values(self, tag: int):
        """Numbers or text of a tag; None where the file lacks it."""
        if tag not in self.entries:
            return None
        letter, number, place = self.entries[tag]
        if letter == "s":
            return self.file.read(place, number).split(b"\0")[0].decode("latin-1")
        form = f"{self.order}{letter * number if len(letter) > 1 else f'{number}{letter}'}"
        return list(struct.unpack(form, self.file.read(place, struct.calcsize(form))))

    def blocks(self) -> tuple[list[int], list[int]]:
        """Where blocks begin and how long they are."""
        offsets, counts = (self.values(324), self.values(325)) if self.tiled else (self.values(273), self.values(279))
        if not offsets or not counts or len(offsets) != len(counts):
            raise ValueError("the tables of blocks disagree")
        return offsets, counts

    @property
    def single_band(self) -> bool:
        """True for measured values, false for a picture."""
        return self.bands == 1 and self.palette is None

    def _affine(self) -> tuple[float, ...] | None:
        """x of column, of row, origin; y likewise."""
        if m := self.values(34264):
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if (s := self.values(33550)) and (t := self.values(33922)):
            return s[0], 0.0, t[3] - t[0] * s[0], 0.0, -s[1], t[4] + t[1] * s[1]
        return None

    def _epsg(self) -> int | None:
        keys = self.values(34735) or []
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return next((found[k] for k in (3072, 2048) if k in found and found[k] != 32767), None)

    def pixel_to_model(self, col: float, row: float) -> tuple[float, float]:
        """Place of a pixel's middle."""
        a, b, c, d, e, f = self.affine
        return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f

    def model_to_pixel(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.affine
        det = a * e - b * d
        return (e * (x - c) - b * (y - f)) / det - 0.5, (a * (y - f) - d * (x - c)) / det - 0.5

    def pieces(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(block, first row in it, rows, place, bytes) of what can be decoded on its own: strips without compression by rows, other blocks whole."""
        line = self.block_w * self.bands * self.dtype.itemsize
        step = max(1, MOST_SAMPLES // max(1, self.block_w * self.bands))
        for block, (offset, count) in enumerate(zip(*self.blocks(), strict=True)):
            high = self.block_h if self.tiled else min(self.block_h, self.height - block * self.block_h)
            if self.tiled or self.compression != 1 or self.predictor == 3:
                yield block, 0, high, offset, count
            else:
                for row in range(0, high, step):
                    rows = min(step, high - row)
                    yield block, row, rows, offset + row * line, rows * line

    def piece(self, block: int, row: int, rows: int, offset: int, count: int) -> tuple[int, int, np.ndarray]:
        """First column and row of a piece, and its values (row, column, band) cut to the image."""
        across = -(-self.width // self.block_w)
        col, row = block % across * self.block_w, block // across * self.block_h + row
        data = self.file.read(offset, count)
        if len(data) < count:
            raise ValueError(f"block {block} runs past the end of the file")
        if self.compression == 5:
            data = unlzw(data)
        elif self.compression == 32773:
            data = unpackbits(data)
        elif self.compression in (8, 32946):
            data = zlib.decompress(data)
        need = rows * self.block_w * self.bands
        if self.predictor == 3:
            size = self.dtype.itemsize
            lines = np.frombuffer(data, np.uint8, need * size).reshape(rows, -1)
            lines = lines.reshape(rows, -1, self.bands).cumsum(axis=1, dtype=np.uint8).reshape(rows, size, -1)
            values = np.ascontiguousarray(lines.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, self.block_w, self.bands)
        else:
            values = np.frombuffer(data, self.dtype, need).reshape(rows, self.block_w, self.bands)
            if self.predictor == 2:
                values = values.astype(self.dtype.newbyteorder("=")).cumsum(axis=1, dtype=self.dtype.newbyteorder("="))
        return col, row, values[: max(0, self.height - row), : self.width - col]

    def known(self, values: np.ndarray) -> np.ndarray:
        """Which pixels of (row, column, band) hold data: all bands finite and, in one band, not the no-data value."""
        flat = values.astype(np.float64)
        keep = np.isfinite(flat).all(axis=2)
        if self.nodata is not None and self.bands == 1:
            keep &= ~(np.abs(flat[:, :, 0] - self.nodata) <= abs(self.nodata) * 1e-9)
        return keep

    def colours(self, values: np.ndarray) -> np.ndarray:
        """Red, green, blue and alpha (row, column, 4) in bytes of (row, column, band)."""
        whole = {("u", 1): 255.0, ("u", 2): 65535.0}.get((self.dtype.kind, self.dtype.itemsize), 1.0 if self.dtype.kind == "f" else 255.0)
        in_bytes = lambda v, most: np.clip(np.nan_to_num(v.astype(np.float64) / most * 255), 0, 255).astype(np.uint8)
        out = np.full((*values.shape[:2], 4), 255, np.uint8)
        if self.palette is not None:
            index = np.nan_to_num(values[:, :, 0].astype(np.float64)).clip(0).astype(np.int64)
            out[:, :, :3] = np.vstack([self.palette, np.zeros((1, 3), np.uint8)])[np.minimum(index, len(self.palette))]
            return out
        if self.bands >= 3:
            out[:, :, :3] = in_bytes(values[:, :, :3], whole)
        else:
            grey = in_bytes(values[:, :, 0], whole)
            out[:, :, :3] = (255 - grey if self.photometric == 0 else grey)[:, :, None]
        if self.bands >= 4:
            out[:, :, 3] = in_bytes(values[:, :, 3], 65535.0 if self.dtype.itemsize == 2 else 255.0)
        return out

    def describe(self) -> str:
        kind = {"u": "uint", "i": "int", "f": "float"}[self.dtype.kind] + str(8 * self.dtype.itemsize)
        packed = {1: "none", 5: "LZW", 32773: "packbits"}.get(self.compression, "deflate")
        return f"{self.width}x{self.height} · {self.bands} band{'' if self.bands == 1 else 's'} · {kind} · {packed}"


HEADER = "path string, width long, height long, bands int, single_band boolean, epsg int, affine array<double>, nodata double, big boolean, description string"
PIECES = "path string, block long, row0 long, rows long, place long, bytes long"
BLOCKS = "path string, block long, col long, row long, width long, height long, bands int, samples array<double>, colours array<long>"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Size, bands, kind, system and transform of each file; nothing but its directory is read."""

    def run(batches):
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                t = GeoTiff(Ranged(name))
                rows.append((name, t.width, t.height, t.bands, t.single_band, t.epsg, t.affine, t.nodata, t.big, t.describe()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.bool_(), pa.string()]
    names = [f.split()[0] for f in HEADER.split(", ")]
    return files_at(spark, path).select("path").mapInArrow(run, HEADER)


def pieces(spark: SparkSession, path: str, at_once: int = 10_000) -> DataFrame:
    """The blocks of the files (path, block, row0, rows, place, bytes)."""

    def run(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                held = []
                for p in GeoTiff(Ranged(name)).pieces():
                    held.append((name, *p))
                    if len(held) == at_once:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)

    names = [f.split()[0] for f in PIECES.split(", ")]
    return files_at(spark, path).select("path").mapInArrow(run, PIECES)


def read_blocks(spark: SparkSession, path: str, colours: bool = False, tasks: int | None = None) -> DataFrame:
    """path, block, col, row, width, height, bands and the block's pixels line by line: ``samples`` (bands of a pixel together; null where a pixel holds no data) or, with ``colours``, red, green, blue and alpha in one number each.

    Blocks are dealt evenly over ``tasks`` (one a block, 10,000 at most, unless told).
    """
    listed = pieces(spark, path)
    tasks = tasks or min(10_000, max(1, listed.count()))

    def run(batches):
        name, tiff = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != name:
                    name, tiff = r["path"], GeoTiff(Ranged(r["path"]))
                col, row, values = tiff.piece(r["block"], r["row0"], r["rows"], r["place"], r["bytes"])
                step = max(1, MOST_SAMPLES // max(1, values.shape[1] * values.shape[2]))
                for at in range(0, values.shape[0], step):
                    part = values[at : at + step]
                    samples, packed = None, None
                    if colours:
                        packed = pa.array([tiff.colours(part).reshape(-1).view(">u4").astype(np.int64)], pa.list_(pa.int64()))
                    else:
                        flat = pa.array(part.reshape(-1).astype(np.float64), mask=np.repeat(~tiff.known(part).reshape(-1), part.shape[2]))
                        samples = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                    columns = [[name], [r["block"]], [col], [row + at], [part.shape[1]], [part.shape[0]], pa.array([part.shape[2]], pa.int32())]
                    columns += [pa.nulls(1, pa.list_(pa.float64())) if samples is None else samples, pa.nulls(1, pa.list_(pa.int64())) if packed is None else packed]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    names = [f.split()[0] for f in BLOCKS.split(", ")]
    return listed.repartition(tasks).mapInArrow(run, BLOCKS)


def pixels(blocks: DataFrame) -> DataFrame:
    """path, col, row and ``bands`` or ``colour`` of every pixel of the blocks that holds data; colours that are wholly transparent do not."""
    at = lambda i: (F.col("col") + F.col(i) % F.col("width"), F.col("row") + F.floor(F.col(i) / F.col("width")))
    values = blocks.where("samples is not null").select("path", "col", "row", "width", "bands", "samples", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") * F.col("height") - 1)).alias("i"))
    first = (F.col("i") * F.col("bands")).cast("int")
    col, row = at("i")
    values = values.select("path", col.alias("col"), row.alias("row"), F.slice("samples", first + 1, F.col("bands")).alias("bands"), F.lit(None).cast("long").alias("colour")).where(F.get("bands", F.lit(0)).isNotNull())
    pictures = blocks.where("colours is not null").select("path", "col", "row", "width", F.posexplode("colours").alias("i", "colour"))
    pictures = pictures.select("path", col.alias("col"), row.alias("row"), F.lit(None).cast("array<double>").alias("bands"), "colour").where(F.col("colour") % 256 != 0)
    return values.unionByName(pictures)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, col, row, x, y, bands of every pixel that holds data (in one band, differs from the no-data value; finite); x and y are null without a transform."""
    t = headers(spark, path).select("path", "affine")
    middle = lambda k: F.get("affine", F.lit(k)) * (F.col("col") + 0.5) + F.get("affine", F.lit(k + 1)) * (F.col("row") + 0.5) + F.get("affine", F.lit(k + 2))
    return pixels(read_blocks(spark, path)).join(t, "path").select("path", "col", "row", middle(0).alias("x"), middle(3).alias("y"), "bands")
