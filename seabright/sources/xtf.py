"""XTF recordings by byte ranges: one row a channel of a sonar packet.

The file header of 1024 bytes (longer with more than six channels) tells the channels; packets begin with 0xFACE, and bytes between them that
do not are passed over. A packet that is too short or goes over the end of the file ends it.
"""

from __future__ import annotations

import calendar
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.operators.pings import recover_band_centres
from seabright.sources import ranged
from seabright.sources.common import rows_of
from seabright.sources.jsf import INDEX
from seabright.sources.ranged import Ranged

HEADER, CHANNEL, SLOTS, MOST_CHANNELS = 1024, 128, 6, 16
SCHEMA = "path string, offset long, number int, time double, ping long, lat double, lon double, nsamples int, slant_range double, frequency_hz double, heading double, pitch double, roll double, depth double, altitude double, name string, data array<float>"
C_RECORDED = 1500.0
# Bits of a ping's validity.
POSITION, HEADING, ALTITUDE = 1, 8, 64


@dataclass(frozen=True, slots=True)
class Packet:
    at: int
    end: int
    kind: int


@dataclass(frozen=True, slots=True)
class About:
    """What a file's header tells. ``channels`` counts all, ``named`` describes those that the header has room for."""

    program: str
    sonar: str
    channels: int
    named: tuple[tuple[int, str, float], ...]


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip()


def about(file: Ranged) -> About | None:
    """The header of a file; None where the file is shorter. Frequencies under 10,000 are in kilohertz."""
    raw = file.read(0, HEADER + (MOST_CHANNELS - SLOTS) * CHANNEL)
    if len(raw) < HEADER:
        return None
    count, named = sum(struct.unpack_from("<2H", raw, 166)), []
    for at in range(256, min(256 + CHANNEL * min(count, MOST_CHANNELS), len(raw) - CHANNEL + 1), CHANNEL):
        hz = struct.unpack_from("<f", raw, at + 32)[0]
        named.append((min(8, max(1, struct.unpack_from("<H", raw, at + 6)[0])), _text(raw[at + 12 : at + 28]), hz if hz >= 10_000 else hz * 1000))
    return About(_text(raw[6:14]), _text(raw[30:46]), count, tuple(named))


class Packets:
    """How packets follow one another."""

    mark = b"\xce\xfa"

    def first(self, file: Ranged) -> int:
        head = about(file)
        return ranged.ENDED if head is None else HEADER + max(0, head.channels - SLOTS) * CHANNEL

    def next(self, file: Ranged, at: int) -> Packet | None:
        raw = file.read(at, 14)
        if len(raw) == 14 and raw[:2] != self.mark:
            at = file.find(self.mark, at, file.length)
            raw = file.read(at, 14)
        if len(raw) < 14:
            return None
        size = struct.unpack_from("<I", raw, 10)[0]
        return Packet(at, at + size, raw[2]) if size >= 14 and at + size <= file.length else None


def packet_time(raw: bytes, at: int) -> float:
    """Seconds since 1970; not a number where the fields are no date."""
    year, month, day, hour, minute, second, hundredths = struct.unpack_from("<H6B", raw, at)
    if not (1970 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= 31):
        return math.nan
    return calendar.timegm((year, month, 1, 0, 0, 0)) + (day - 1) * 86_400 + hour * 3600 + minute * 60 + second + hundredths / 100


def _packet(path: str, raw: bytes, place: int, named: tuple, traces: bool, more) -> Iterator[dict]:
    """Rows of a sonar packet; ``more(at, size)`` gives its bytes."""
    f = lambda kind, o: struct.unpack_from("<" + kind, raw, o)[0]
    base = {
        "path": path, "offset": place, "time": packet_time(raw, 14), "ping": f("I", 28), "lat": f("d", 60), "lon": f("d", 52),
        "depth": float(f("f", 72)), "heading": float(f("f", 88)), "pitch": float(f("f", 92)), "roll": float(f("f", 96)), "altitude": float(f("f", 100)),
    }
    at, size = 256, struct.unpack_from("<I", raw, 10)[0]
    for _ in range(min(raw[9], 8)):
        sub = more(at, 64) if at + 64 <= size else b""
        if len(sub) < 64:
            return
        number, n, slant = struct.unpack_from("<H", sub, 2)[0] & 255, struct.unpack_from("<I", sub, 8)[0], struct.unpack_from("<f", sub, 40)[0]
        width, name, hz = named[number] if number < len(named) else (2, "", 0.0)
        if at + 64 + n * width > size:
            return
        data = None
        if traces:
            data = np.frombuffer(more(at + 64, n * width), f"<u{width}").astype(np.float32) if width in (1, 2, 4) else np.zeros(0, np.float32)
        yield base | {"number": number, "nsamples": n, "slant_range": float(slant), "frequency_hz": float(hz), "name": name, "data": data}
        at += 64 + n * width


def span_rows(path: str, file: Ranged, at: int, end: int, traces: bool = True) -> Iterator[dict]:
    """Rows of the packets that begin from ``at`` to ``end``."""
    head = about(file)
    if head is None:
        return
    at = Packets().first(file) if at == 0 else at
    for p in ranged.walk(Packets(), file, at, end):
        if p.kind == 0 and p.end - p.at >= 256:
            raw = file.read(p.at, p.end - p.at if traces else 256)
            more = (lambda o, n, raw=raw: raw[o : o + n]) if traces else (lambda o, n, p=p: file.read(p.at + o, min(n, p.end - p.at - o)))
            yield from _packet(path, raw, p.at, head.named, traces, more)


def read_xtf(spark: SparkSession, path: str, traces: bool = True, size: int = ranged.RANGE) -> DataFrame:
    """The sonar channels of the recordings at ``path`` (a file, folder or glob), in tasks of ``size`` bytes; ``subsystem`` and ``channel`` are the set of frequencies and the side of ``number``."""
    rows = ranged.rows_of_spans(ranged.spans(spark, path, Packets(), size), SCHEMA, lambda name, file, at, end: span_rows(name, file, at, end, traces))
    return rows.withColumns({"subsystem": 20 + F.shiftright("number", 1), "channel": F.col("number").bitwiseAND(1)})


def with_index(packets: DataFrame) -> DataFrame:
    """Rows of ``read_xtf`` with what an index derives: which values are valid, and the time between samples that the slant range makes at the recorded speed of sound."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    flag = lambda cond, bit: F.when(cond, bit).otherwise(0)
    validity = flag(F.col("altitude") > 0, ALTITUDE) + flag(finite("lat") & finite("lon"), POSITION) + flag(finite("heading"), HEADING)
    interval = F.when((F.col("nsamples") > 0) & (F.col("slant_range") > 0), F.floor(F.col("slant_range") / F.col("nsamples") * 2 / C_RECORDED * 1e9)).otherwise(0)
    return packets.withColumns({"validity": validity, "interval_ns": interval})


def index_rows(packets: DataFrame) -> DataFrame:
    """Rows of ``read_xtf`` as an index has pings."""
    zero = {"f0": F.lit(0.0), "f1": F.lit(0.0), "weight": F.lit(0), "fmt": F.lit(0)}
    return with_index(packets).withColumns({"nsamples": F.least("nsamples", F.lit(65_535)), **zero}).select(*INDEX)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, name, frequency_hz, program, sonar) of every channel that the files' headers describe; no more than the headers is read."""
    schema = "path string, number int, name string, frequency_hz double, program string, sonar string"

    def rows(name: str) -> Iterator[dict]:
        if (head := about(Ranged(name))) is not None:
            for number, (_, channel, hz) in enumerate(head.named):
                yield {"path": name, "number": number, "name": channel, "frequency_hz": float(hz), "program": head.program, "sonar": head.sonar}

    files = ranged.files_at(spark, path)
    return rows_of(files.select("path"), schema, lambda batch: ((n,) for n in batch.column("path").to_pylist()), rows)


def scan_bands(spark: SparkSession, folder: str, bands: DataFrame) -> DataFrame:
    """dataset, subsystem, recorded, centre: ``bands`` (dataset, subsystem, recorded) with the centres that a recorder's 16-bit field has wrapped put right by the headers of the XTF files in the folder of that name."""
    found = file_headers(spark, folder).where(F.lower("path").endswith(".xtf") & (F.col("frequency_hz") > 0))
    seen = found.select(F.element_at(F.split("path", "/"), -2).alias("dataset"), F.struct("path", "number").alias("place"), F.col("frequency_hz").alias("hz"))
    return recover_band_centres(bands, seen, "dataset")
