import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seabright.operators import report, turns
from seabright.sources import geojson, png
from seabright.streaming import ingest


def decode(raw):
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, data = 8, b""
    while at < len(raw):
        n, name = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + body)
        if name == b"IHDR":
            w, h, _, kind = struct.unpack(">2I2B", body[:10])
        data += body * (name == b"IDAT")
        at += 12 + n
    channels = {0: 1, 4: 2, 2: 3, 6: 4}[kind]
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)[:, 1:].reshape(h, w, channels)


def test_png():
    rng = np.random.default_rng(0)
    colour = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    assert (decode(png.encode(colour)) == colour).all()
    grey = np.repeat(colour[:, :, :1], 3, axis=2)
    assert decode(png.encode(grey)).shape == (5, 7, 1)
    assert decode(png.encode(np.dstack([grey, np.full((5, 7), 255)]))).shape == (5, 7, 1)


def test_tiles(spark):
    df = spark.createDataFrame([(0, 0, 9, 8, 7), (300, 5, 1, 2, 3)], "gx long, gy long, r int, g int, b int")
    got = {(r.tx, r.ty): decode(bytes(r.png)) for r in png.tiles(df).collect()}
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0][0, 0].tolist() == [9, 8, 7, 255] and got[1, 0][5, 44].tolist() == [1, 2, 3, 255]
    rows = spark.createDataFrame([("d", i, bytes([i, 255])) for i in range(3)], "dataset string, row long, pixels binary")
    assert decode(bytes(png.rows_image(rows).first().png))[:, :, 0].tolist() == [[0, 255], [1, 255], [2, 255]]


@pytest.mark.parametrize("end", [(200, 0, 0), (0, 80, math.pi), (10, 5, 1), (-3, 4, -2), (0, 0, 3), (100, -100, math.pi / 2)])
def test_turns_arrive(end):
    word, lengths = turns.turn_path((0.0, 0.0, 0.5), end, 40.0)
    points = turns.turn_points((0.0, 0.0, 0.5), word, lengths, 40.0)
    assert math.dist(points[-1], end[:2]) < 1e-6
    for other in turns.WORDS:
        d, way = math.hypot(end[0], end[1]) / 40, math.atan2(end[1], end[0])
        if s := turns._solve(other, d, 0.5 - way, end[2] - way):
            arrived = turns.turn_points((0.0, 0.0, 0.5), other, tuple(40 * x for x in s), 40.0)[-1]
            assert math.dist(arrived, end[:2]) < 1e-6 and sum(s) * 40 >= sum(lengths) - 1e-9


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([("C001", 52.5, 4.0, None), ("C002", 52.6, 4.1, "a \"b\"")], "id string, lat double, lon double, note string")
    features = [json.loads(r.feature) for r in geojson.contact_features(df).orderBy("id").collect()]
    assert features[0]["geometry"] == {"type": "Point", "coordinates": [4.0, 52.5]}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    back = geojson.read_contacts(spark, str(tmp_path / "c.geojson")).orderBy("id").collect()
    assert [(r.id, r.lat, r.lon, r.note) for r in back] == [("C001", 52.5, 4.0, None), ("C002", 52.6, 4.1, 'a "b"')]
    fixes = spark.createDataFrame([("d", 1, 52.0, 4.0), ("d", 0, 51.0, 3.0)], "dataset string, seq int, lat double, lon double")
    assert json.loads(geojson.track_features(fixes).first().feature)["geometry"]["coordinates"] == [[3.0, 51.0], [4.0, 52.0]]


def test_report(spark):
    pings = spark.createDataFrame([("a", 0.0), ("a", 3661.0), ("b", 10.0)], "dataset string, time double")
    track = spark.createDataFrame([("a", 52.0, 4.0, 1500.0)], "dataset string, lat double, lon double, dist double")
    lines = spark.createDataFrame([("a", "line"), ("a", "turn")], "dataset string, kind string")
    summary = report.dataset_summary(pings, track, lines).orderBy("dataset")
    a, b = summary.collect()
    assert (a.pings, a.metres, a.lines, a.duration) == (2, 1500.0, 1, "1:01:01") and (b.metres, b.lines) == (None, 0)
    assert report.totals(summary).first().km == 1.5
    page = report.render("A & B", {"Recordings": summary.select("dataset", "pings")})
    assert "A &amp; B" in page and "<td>a</td><td>2</td>" in page
    with pytest.raises(ValueError):
        report.render("x", {"y": summary}, most_rows=1)
    table = report.contact_table(spark.createDataFrame([("C1", 52.5, 4.02)], "id string, lat double, lon double"), [32631, 28992]).first()
    assert abs(table.x_32631 - 569239.787) < 0.01 and abs(table.x_28992 - 62164.14) < 1.5


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i * 60, 20 + i % 2, 1.0, 2.0) for i in range(40)], "s long, subsystem int, f0 double, f1 double").select(F.timestamp_seconds("s").alias("ts"), "subsystem", "f0", "f1")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.band_counts(stream).writeStream.outputMode("complete").format("memory").queryName("bands").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.begins, r.subsystem): r.pings for r in ingest.band_counts(rows).collect()}
    assert {(r.begins, r.subsystem): r.pings for r in spark.table("bands").collect()} == want
