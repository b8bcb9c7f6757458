"""JSF recordings by byte ranges: one row a sonar message or NMEA sentence.

A recording is a run of messages, each with a 16-byte header. A cut-off last message ends the file quietly; bytes that are no header
end it with a row in ``warning``. Bodies are fetched only where they are asked for: no samples without ``traces``, and nothing but the headers of messages
that ``subsystems``, ``since`` and ``until`` leave out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seabright.sources import ranged
from seabright.sources.ranged import Ranged

MARKER = 0x1601
SONAR, NMEA = 80, 2002
HEADER = struct.Struct("<HBBHBBBBHI")
#: Bytes of a sonar message before its samples.
SONAR_HEADER = 240

# Names of message types and subsystems; any other is "unknown".
MESSAGE_NAMES = {
    40: "raw serial", 80: "sonar data", 82: "sonar data (compressed)", 86: "sonar data 2", 181: "system information (old)", 182: "system information", 426: "file timestamp", 428: "file padding",
    2002: "NMEA string", 2020: "pressure sensor", 2040: "miscellaneous analog", 2060: "pipe echo detect", 2080: "container timestamp", 2101: "situation", 2111: "cable counter",
}
SUBSYSTEM_NAMES = {0: "sub-bottom", 20: "sidescan (set 1)", 21: "sidescan (set 2)", 100: "NMEA/nav", 101: "pressure", 102: "analog"}


def named(code, names: dict[int, str]):
    """Column of the name of a code."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code.cast("int")), F.lit("unknown"))


SCHEMA = """path string, offset long, subsystem int, channel int, time double, ping long, validity int, lat double, lon double,
    nsamples int, interval_ns long, start_depth long, f0 double, f1 double, mixer_hz double, pressure_psi double, depth double, altitude double, sound_speed double, gain int, max_adc int, weight int, fmt int,
    heading double, pitch double, roll double, course double, speed double, clock double, software string, data array<float>, sentence string, warning string"""


@dataclass(frozen=True, slots=True)
class Header:
    """A message's place and what its header tells; ``kind`` is -1 where bytes are no header."""

    at: int
    end: int
    kind: int
    subsystem: int
    channel: int


class Messages:
    """How messages follow one another; the walk ends at the first bytes that are no header, after one message of kind -1 that tells so."""

    mark = MARKER.to_bytes(2, "little")

    def first(self, file: Ranged) -> int:
        return 0

    def next(self, file: Ranged, at: int) -> Header | None:
        raw = file.read(at, HEADER.size)
        if len(raw) < HEADER.size:
            return None
        marker, _, _, kind, _, subsystem, channel, _, _, size = HEADER.unpack(raw)
        if marker != MARKER:
            return None
        end = at + HEADER.size + size
        return Header(at, end, kind, subsystem, channel) if end <= file.length else None


def samples(raw: memoryview, fmt: int, weight: int, n: int) -> np.ndarray:
    """Amplitudes: in-phase and quadrature pairs (1), unsigned (9) or signed words, scaled by a power of two."""
    words = 2 if fmt == 1 else 1
    n = min(n, len(raw) // (2 * words))
    values = np.frombuffer(raw, "<u2" if fmt == 9 else "<i2", n * words).astype(np.float64)
    if fmt == 1:
        values = np.hypot(values[0::2], values[1::2])
    return np.ldexp(values, -weight).astype(np.float32)


def degrees(raw: int, units: int) -> float:
    """Ten-thousandths of minutes (2) or millionths of degrees (3); grid metres are no degrees."""
    return raw / 1e4 / 60 if units == 2 else raw / 1e6 if units == 3 else float("nan")


def index_degrees(raw: int, units: int) -> float:
    """As the index of a recording has it: whatever is not in minutes is in micro-degrees."""
    return raw / 1e4 / 60 if units == 2 else raw / 1e6


def clock(year: int, day: int, hour: int, minute: int, second: int) -> float | None:
    """Seconds since 1970 of the message's own calendar fields; None where they are no time."""
    if not (1970 <= year <= 2100 and 1 <= day <= 366 and 0 <= hour < 24 and 0 <= minute < 60 and 0 <= second < 62):
        return None
    date = np.datetime64(f"{year:04d}-01-01") + (day - 1)
    return float(date.astype("datetime64[s]").astype(np.int64)) + hour * 3600 + minute * 60 + second if date.astype(object).year == year else None


def sonar_row(body: bytes, traces: bool = True) -> dict | None:
    """Fields of a sonar message; None for one too short to be one. Without ``traces`` only its header is decoded, as for an index."""
    if len(body) < SONAR_HEADER:
        return None
    at = lambda f, o: struct.unpack_from("<" + f, body, o)[0]
    place = degrees if traces else index_degrees
    units, n, fmt, weight = at("h", 88), at("H", 114), at("h", 34), at("h", 168)
    return {
        "time": at("i", 0) + at("I", 200) % 1000 / 1000, "ping": at("I", 8), "validity": at("H", 30), "lon": place(at("i", 80), units), "lat": place(at("i", 84), units),
        "nsamples": n, "interval_ns": at("I", 116), "start_depth": at("I", 4), "f0": at("H", 126) * 10.0, "f1": at("H", 128) * 10.0, "mixer_hz": float(at("f", 152)), "pressure_psi": at("i", 132) / 1000,
        "depth": at("i", 136) / 1000, "altitude": at("i", 144) / 1000, "sound_speed": float(at("f", 148)), "gain": at("H", 120), "max_adc": at("H", 204), "weight": weight, "fmt": fmt,
        "heading": at("H", 172) / 100, "pitch": at("h", 174) * 180 / 32768, "roll": at("h", 176) * 180 / 32768, "course": float(at("h", 192)), "speed": at("h", 194) / 10,
        "clock": clock(*(at("h", o) for o in (156, 158, 160, 162, 164))), "software": bytes(body[210:216]).split(b"\0")[0].decode("utf-8", "replace"),
        "data": samples(memoryview(body)[SONAR_HEADER:], fmt, weight, n) if traces else None,
    }


@dataclass(frozen=True, slots=True)
class Wanted:
    """What is read of a recording: samples or not, and which subsystems and seconds, ``until`` excluded. What is not, is not fetched."""

    traces: bool = True
    subsystems: tuple[int, ...] | None = None
    since: float | None = None
    until: float | None = None

    def of(self, subsystem: int) -> bool:
        return self.subsystems is None or subsystem in self.subsystems

    def at(self, time: float) -> bool:
        return (self.since is None or time >= self.since) and (self.until is None or time < self.until)


def _row(path: str, file: Ranged, m: Header, wanted: Wanted) -> Iterator[dict]:
    body, size = m.at + HEADER.size, m.end - m.at - HEADER.size
    base = {"path": path, "offset": m.at, "subsystem": m.subsystem, "channel": m.channel}
    if m.kind == SONAR and size >= SONAR_HEADER and wanted.of(m.subsystem):
        head = file.read(body, SONAR_HEADER)
        row = sonar_row(head, False)
        if wanted.at(row["time"]):
            yield base | (sonar_row(head + file.read(body + SONAR_HEADER, size - SONAR_HEADER)) if wanted.traces else row)
    elif m.kind == NMEA and size > 12 and wanted.subsystems is None:
        time = float(struct.unpack("<i", file.read(body, 4))[0])
        if wanted.at(time):
            yield base | {"time": time, "sentence": file.read(body + 12, size - 12).split(b"\0")[0].decode("utf-8", "replace").strip()}


def span_rows(path: str, file: Ranged, at: int, end: int, wanted: Wanted = Wanted()) -> Iterator[dict]:
    """Rows of the messages that begin from ``at`` to ``end``."""
    for m in ranged.walk(Messages(), file, at, end):
        at = m.end
        yield from _row(path, file, m, wanted)
    if at < end and len(raw := file.read(at, HEADER.size)) == HEADER.size and raw[:2] != Messages.mark:
        yield {"path": path, "offset": at, "warning": f"lost sync at byte {at}"}


def read_jsf(spark: SparkSession, path: str, traces: bool = True, subsystems: tuple[int, ...] | None = None, since: float | None = None, until: float | None = None, size: int = ranged.RANGE) -> DataFrame:
    """The messages of the recordings at ``path`` (a file, folder or glob), in tasks of ``size`` bytes. Sentences belong to no subsystem: a choice of these leaves them out."""
    wanted = Wanted(traces, subsystems, since, until)
    return ranged.rows_of_spans(ranged.spans(spark, path, Messages(), size), SCHEMA, lambda name, file, at, end: span_rows(name, file, at, end, wanted))


def message_at(file: Ranged, offset: int) -> tuple[Header, bytes] | None:
    """The message that begins at a place and its body, which a cut-off file may shorten; None where none begins."""
    raw = file.read(offset, HEADER.size)
    if len(raw) < HEADER.size or raw[:2] != Messages.mark:
        return None
    _, _, _, kind, _, subsystem, channel, _, _, size = HEADER.unpack(raw)
    body = file.read(offset + HEADER.size, size)
    return Header(offset, offset + HEADER.size + len(body), kind, subsystem, channel), body


def ping_at(path: str, file: Ranged, offset: int) -> Iterator[dict]:
    found = message_at(file, offset)
    if found and found[0].kind == SONAR and (row := sonar_row(found[1])):
        yield {"path": path, "offset": offset, "subsystem": found[0].subsystem, "channel": found[0].channel} | row


def pings_at(spark: SparkSession, path: str, wanted: DataFrame, size: int = ranged.RANGE) -> DataFrame:
    """The sonar messages that begin at given places: ``wanted`` holds path and offset. Only those are fetched; a place where none begins, or in a file that is not at ``path``, gives no row."""
    asked = wanted.select("path", "offset").join(ranged.files_at(spark, path).select("path"), "path", "left_semi")
    return ranged.rows_at(asked, SCHEMA, ping_at, size)


#: What an index keeps of a ping.
INDEX = ["path", "offset", "subsystem", "channel", "time", "ping", "validity", "lat", "lon", "nsamples", "interval_ns", "f0", "f1", "depth", "altitude", "heading", "pitch", "roll", "weight", "fmt"]


def ping_index(rows: DataFrame, seconds: int = 600) -> DataFrame:
    """Sonar messages of JSF or XTF recordings (see ``xtf.index_rows``) numbered within their folder in order of time, ties by file and place. Spans of time are numbered on their own and then put one after the other."""
    if "sentence" in rows.columns:
        rows = rows.where("sentence is null and warning is null")
    pings = rows.select(*INDEX).withColumns({"dataset": F.element_at(F.split("path", "/"), -2), "span": F.floor(F.col("time") / seconds)})
    counts = pings.groupBy("dataset", "span").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("dataset").orderBy(F.col("span").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("dataset", "span", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("dataset", "span").orderBy("time", "path", "offset", "subsystem", "channel")
    numbered = pings.withColumn("at", F.row_number().over(order) - 1).join(starts.withColumnRenamed("dataset", "of"), (F.col("dataset") == F.col("of")) & pings["span"].eqNullSafe(starts["span"]))
    return numbered.select(*INDEX, "dataset", (F.col("before") + F.col("at")).alias("rec_id"))
