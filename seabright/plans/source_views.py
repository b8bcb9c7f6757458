"""Queries of the file sources over the driver's tables: tasks write recordings, grids and tracks made of the tables to the shared folder, and the sources read them."""

from __future__ import annotations

import struct
import time
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.operators.stored import shared_dir
from seabright.plans import views as v
from seabright.plans.survey_views import query, r
from seabright.sources import geotiff, gpx, jsf, ranged, xtf


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/seabright/files-{uuid.uuid4().hex}"


def _written(rows: DataFrame, by: str, name, encode) -> None:
    """A file for each group of rows, written by the task that holds it: ``encode(rows)`` at ``name(key)``."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        path = name(part[by].iloc[0])
        ranged.write(path, encode(part))
        return pd.DataFrame({"path": [path]})

    rows.groupBy(by).applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()


#: What a sonar message tells here: (type, place in the message, value of the pings).
_TOLD = [
    ("<u2", 0, lambda p: jsf.MARKER), ("u1", 2, lambda p: 1), ("<u2", 4, lambda p: jsf.SONAR), ("u1", 7, lambda p: p["subsystem"]), ("u1", 8, lambda p: p["channel"]), ("<u4", 12, lambda p: 240 + 2 * (p["rec_id"] % 5 + 1)),
    ("<i4", 16, lambda p: np.floor(p["time"])), ("<u4", 24, lambda p: p["rec_id"]), ("<u2", 46, lambda p: p["validity"]), ("<i4", 96, lambda p: np.floor(p["lon"] * 600_000 + 0.5)), ("<i4", 100, lambda p: np.floor(p["lat"] * 600_000 + 0.5)),
    ("<i2", 104, lambda p: 2), ("<u2", 130, lambda p: p["rec_id"] % 5 + 1), ("<u4", 132, lambda p: p["interval_ns"]), ("<u2", 142, lambda p: p["f0"] // 10), ("<u2", 144, lambda p: p["f1"] // 10), ("<i4", 160, lambda p: p["rec_id"] % 30_000),
    ("<i2", 184, lambda p: 1), ("<u2", 188, lambda p: p["heading"] * 100), ("<u4", 216, lambda p: p["rec_id"] % 1000),
]


def _jsf(part: pd.DataFrame) -> bytes:
    part = part.sort_values("rec_id")
    heads = np.zeros(len(part), np.dtype({"names": [str(at) for _, at, _ in _TOLD], "formats": [kind for kind, _, _ in _TOLD], "offsets": [at for _, at, _ in _TOLD], "itemsize": 256}))
    for _, at, value in _TOLD:
        heads[str(at)] = value(part)
    samples = {(n, k): (np.arange(n) * 2 + k).astype("<i2").tobytes() for n in range(1, 6) for k in range(7)}
    raw = heads.tobytes()
    return b"".join(raw[256 * i : 256 * (i + 1)] + samples[rec_id % 5 + 1, rec_id % 7] for i, rec_id in enumerate(part["rec_id"].tolist()))


def _recorded(spark: SparkSession, sf_dir: str, ending: str, encode) -> str:
    folder = _folder(spark)
    _written(v.pings(spark, sf_dir), "dataset", lambda key: f"{folder}/{key}/a.{ending}", encode)
    return folder


def _dataset():
    """The recording's folder."""
    return F.element_at(F.split("path", "/"), -2).cast("long").alias("dataset")


@query(f"""
with {v.PINGS} select dataset, subsystem, channel, rec_id as ping, floor(time) + rec_id % 1000 / 1000::double as time, round(floor(lat * 600000 + 0.5) / 1e4::double / 60, 9) as lat, round(floor(lon * 600000 + 0.5) / 1e4::double / 60, 9) as lon, validity,
    rec_id % 5 + 1 as nsamples, interval_ns, f0 // 10 * 10::double as f0, f1 // 10 * 10::double as f1, rec_id % 30000 / 1000::double as altitude, heading, (rec_id % 5 + 1) * (rec_id % 5 + rec_id % 7) / 2::double as total from v_pings
""")
def recorded_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSF recordings in ranges of 64 KB."""
    rows = jsf.read_jsf(spark, _recorded(spark, sf_dir, "jsf", _jsf), size=1 << 16)
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        _dataset(), F.col("subsystem").cast("long").alias("subsystem"), F.col("channel").cast("long").alias("channel"), "ping", "time", r("lat", 9), r("lon", 9), F.col("validity").cast("long").alias("validity"), F.col("nsamples").cast("long").alias("nsamples"),
        "interval_ns", "f0", "f1", "altitude", "heading", total.alias("total"),
    )


@query(f"""
with {v.PINGS}, t as (select *, floor(time) + rec_id % 1000 / 1000::double as began from v_pings)
select dataset, rec_id as ping, row_number() over (partition by dataset order by began, rec_id) - 1 as rec_id from t where subsystem = 20 and began >= (select floor(min(time)) + 86400 from v_pings)
""")
def recorded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of one band after the first day: headers only, and of those no more than the filter needs."""
    start = v.pings(spark, sf_dir).agg(F.floor(F.min("time"))).first()[0]
    rows = jsf.read_jsf(spark, _recorded(spark, sf_dir, "jsf", _jsf), traces=False, subsystems=(20,), since=float(start + 86400), size=1 << 16)
    return jsf.ping_index(rows).select(F.col("dataset").cast("long").alias("dataset"), "ping", F.col("rec_id").cast("long").alias("rec_id"))


@query(f"with {v.PINGS} select dataset, rec_id as ping, (rec_id % 5 + 1) * (rec_id % 5 + rec_id % 7) / 2::double as total from v_pings where rec_id % 9 = 0")
def recorded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of every ninth ping, fetched by the places that the index knows."""
    folder = _recorded(spark, sf_dir, "jsf", _jsf)
    asked = jsf.read_jsf(spark, folder, traces=False, size=1 << 16).where("ping % 9 = 0").select("path", "offset")
    found = jsf.pings_at(spark, folder, asked, size=1 << 16)
    return found.select(_dataset(), "ping", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _xtf(part: pd.DataFrame) -> bytes:
    head = bytearray(1024)
    head[0] = 0x7B
    struct.pack_into("<2H", head, 166, 4, 0)
    for k in range(4):
        struct.pack_into("<H", head, 256 + 128 * k + 6, 2)
        head[256 + 128 * k + 12 : 256 + 128 * k + 15] = b"ch%d" % k
        struct.pack_into("<f", head, 256 + 128 * k + 32, 400.0 + k)
    out = [bytes(head)]
    for x in part.sort_values("rec_id").itertuples(index=False):
        n = int(x.rec_id % 4 + 1)
        packet, sub, at = bytearray(256), bytearray(64), time.gmtime(int(np.floor(x.time)))
        struct.pack_into("<HBB", packet, 0, 0xFACE, 0, 0)
        packet[9] = 1
        struct.pack_into("<I", packet, 10, 256 + 64 + 2 * n)
        struct.pack_into("<H6B", packet, 14, at.tm_year, at.tm_mon, at.tm_mday, at.tm_hour, at.tm_min, at.tm_sec, int(x.rec_id % 100))
        struct.pack_into("<I", packet, 28, x.rec_id)
        struct.pack_into("<2d", packet, 52, x.lon, x.lat)
        struct.pack_into("<f", packet, 88, x.heading)
        struct.pack_into("<f", packet, 100, float(x.rec_id % 3 - 1))
        struct.pack_into("<H", sub, 2, int(x.rec_id % 4))
        struct.pack_into("<I", sub, 8, n)
        struct.pack_into("<f", sub, 40, 75.0)
        out += [bytes(packet), bytes(sub), (np.arange(n) + x.rec_id % 11).astype("<u2").tobytes(), b"pad" * int(x.rec_id % 2)]
    return b"".join(out)


@query(f"""
with {v.PINGS} select dataset, rec_id as ping, 20 + rec_id % 4 // 2 as subsystem, rec_id % 2 as channel, floor(time) + rec_id % 100 / 100::double as time, lat, lon, heading, case when rec_id % 3 = 2 then 73 else 9 end as validity,
    cast(floor(75 / (rec_id % 4 + 1)::double * 2 / 1500::double * 1e9::double) as bigint) as interval_ns, rec_id % 4 + 1 as nsamples, 1000 * (400 + rec_id % 4)::double as frequency_hz, (rec_id % 4 + 1) * (rec_id % 4 + 2 * (rec_id % 11)) / 2::double as total from v_pings
""")
def packet_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XTF recordings in ranges of 64 KB, with bytes between packets."""
    rows = xtf.with_index(xtf.read_xtf(spark, _recorded(spark, sf_dir, "xtf", _xtf), size=1 << 16))
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        _dataset(), "ping", F.col("subsystem").cast("long").alias("subsystem"), F.col("channel").cast("long").alias("channel"), "time", "lat", "lon", "heading", F.col("validity").cast("long").alias("validity"), "interval_ns",
        F.col("nsamples").cast("long").alias("nsamples"), "frequency_hz", total.alias("total"),
    )


WIDE, STRIP = 211, 16


def _tiff(part: pd.DataFrame) -> bytes:
    """A grid of the rows' values, packed in strips with the horizontal predictor."""
    tall = int(part["row"].max()) + 1
    grid = np.zeros((tall, WIDE), "<i4")
    grid[part["row"], part["col"]] = part["value"]
    strips = []
    for at in range(0, tall, STRIP):
        lines = grid[at : at + STRIP]
        strips.append(zlib.compress(np.concatenate([lines[:, :1], np.diff(lines, axis=1)], axis=1).astype("<i4").tobytes()))
    offsets = [8 + sum(map(len, strips[:k])) for k in range(len(strips))]
    entries = [(256, 4, [WIDE]), (257, 4, [tall]), (258, 3, [32]), (259, 3, [8]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 4, [STRIP]), (279, 4, [len(s) for s in strips]), (317, 3, [2]), (339, 3, [2]),
               (33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 572_000.0, 5_824_500.0, 0.0]), (42113, 2, b"0\0")]
    at = 8 + sum(map(len, strips))
    base, extra, body = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}".replace(" ", ""), *values)
        field = raw.ljust(4, b"\0")
        if len(raw) > 4:
            field, extra = struct.pack("<I", base + len(extra)), extra + raw
        body += struct.pack("<HHI", tag, kind, len(values)) + field
    return b"II" + struct.pack("<HI", 42, at) + b"".join(strips) + struct.pack("<H", len(entries)) + body + b"\0" * 4 + extra


@query(f"""
select o_custkey % 4 as file, o_orderkey // 4 % {WIDE} as col, o_orderkey // 4 // {WIDE} as row, 572000 + (o_orderkey // 4 % {WIDE} + 0.5) * 0.5::double as x, 5824500 - (o_orderkey // 4 // {WIDE} + 0.5) * 0.5::double as y, max(o_orderkey % 1000)::double as value
from orders group by all having max(o_orderkey % 1000) <> 0
""")
def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoTIFF grids, a strip a task; zero is no data."""
    folder, k = _folder(spark), F.col("o_orderkey")
    cell = F.floor(k / 4)
    rows = v.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 4).alias("file"), (cell % WIDE).alias("col"), F.floor(cell / WIDE).alias("row")).agg(F.max(k % 1000).alias("value"))
    _written(rows, "file", lambda key: f"{folder}/{key}.tif", _tiff)
    got = geotiff.read_geotiff(spark, folder)
    return got.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("file"), "col", "row", "x", "y", F.get("bands", F.lit(0)).alias("value"))


@query(f"with {v.FIXES} select dataset, seq, round(lat, 7) as lat, round(lon, 7) as lon, 'fix & ' || seq as name from v_fixes")
def track_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen GPX documents with a track for each recording, written and read again."""
    folder = _folder(spark)
    f, name = v.fixes(spark, sf_dir), F.col("dataset").cast("string")
    points = f.select((F.col("dataset") % 16).cast("string").alias("path"), F.col("dataset").cast("int").alias("line"), name.alias("line_name"), "seq", "lat", "lon", F.concat(F.lit("fix & "), F.col("seq").cast("string")).alias("name"))
    gpx.write_documents(gpx.documents(points), folder)
    return gpx.read_gpx(spark, folder).select(F.col("line_name").cast("long").alias("dataset"), F.col("seq").cast("long").alias("seq"), r("lat", 7), r("lon", 7), "name")
