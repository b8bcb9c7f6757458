import struct
import zlib

import numpy as np
import pytest

from seabright.sources import geotiff, gpx, jsf, ranged, xtf


def jsf_message(kind, body, subsystem=20, channel=0):
    return struct.pack("<HBBHBBBBHi", 0x1601, 1, 0, kind, 0, subsystem, channel, 0, 0, len(body)) + body


def sonar_body(samples, fmt=0, weight=1):
    body = bytearray(240)
    for kind, at, value in (("i", 0, 1_700_000_000), ("I", 8, 7), ("H", 30, 64), ("h", 34, fmt), ("i", 80, 2_412_000), ("i", 84, 31_500_000), ("h", 88, 2), ("H", 114, len(samples)), ("I", 116, 20_000), ("H", 126, 40_000), ("i", 144, 8_500), ("h", 168, weight), ("H", 172, 9_000)):
        struct.pack_into("<" + kind, body, at, value)
    return bytes(body) + np.asarray(samples, "<i2").tobytes()


def test_jsf(spark, tmp_path):
    raw = jsf_message(80, sonar_body([2, 4, 6])) + jsf_message(2002, struct.pack("<iii", 1_700_000_001, 0, 0) + b"$GPGGA,1\0") + jsf_message(80, sonar_body([2]), 21, 1)
    folder = tmp_path / "line1"
    folder.mkdir()
    (folder / "a.jsf").write_bytes(raw + raw[:30])
    (folder / "b.jsf").write_bytes(jsf_message(80, sonar_body([8])) + b"junk that is not a header")
    got = jsf.read_jsf(spark, str(folder)).orderBy("path", "offset").collect()
    assert [r.sentence for r in got if r.sentence] == ["$GPGGA,1"] and sum(bool(r.warning) for r in got) == 1
    first = got[0]
    assert first.data == [1, 2, 3] and (first.ping, first.f0, first.altitude, first.heading) == (7, 400_000, 8.5, 90)
    assert abs(first.lat - 52.5) < 1e-9 and abs(first.lon - 4.02) < 1e-9
    index = jsf.ping_index(jsf.read_jsf(spark, str(folder), traces=False))
    assert sorted(r.rec_id for r in index.collect()) == [0, 1, 2] and {r.dataset for r in index.collect()} == {"line1"}
    assert jsf.samples(memoryview(np.array([3, 4], "<i2").tobytes()), 1, 0, 1).tolist() == [5]


def xtf_file(names=2, pings=1, samples=3, pad=b""):
    head = bytearray(1024 + max(0, names - 6) * 128)
    head[0] = 0x7B
    struct.pack_into("<2H", head, 166, names, 0)
    for i in range(names):
        struct.pack_into("<H", head, 256 + 128 * i + 6, 2)
        head[256 + 128 * i + 12 : 256 + 128 * i + 16] = b"ch%02d" % i
        struct.pack_into("<f", head, 256 + 128 * i + 32, 600.0 if i < 2 else 900_000.0)
    out = bytes(head) + pad
    for k in range(pings):
        ping, body = bytearray(256), b""
        for number in range(names):
            sub = bytearray(64)
            struct.pack_into("<H", sub, 2, number)
            struct.pack_into("<I", sub, 8, samples)
            struct.pack_into("<f", sub, 40, 75.0)
            body += bytes(sub) + (np.arange(1, samples + 1) + k).astype("<u2").tobytes()
        struct.pack_into("<HBB", ping, 0, 0xFACE, 0, 0)
        ping[9] = names
        struct.pack_into("<I", ping, 10, 256 + len(body))
        struct.pack_into("<H6B", ping, 14, 2023, 11, 14, 22, 13, 20 + k % 30, 50)
        struct.pack_into("<I", ping, 28, k)
        struct.pack_into("<2d", ping, 52, 4.02, 52.5)
        struct.pack_into("<f", ping, 88, 90.0)
        struct.pack_into("<f", ping, 100, 8.5)
        out += bytes(ping) + body
    return out


def test_xtf(spark, tmp_path):
    (tmp_path / "a.xtf").write_bytes(xtf_file(pad=b"pad") + b"\xce\xfa")
    got = xtf.read_xtf(spark, str(tmp_path / "a.xtf")).orderBy("channel").collect()
    assert [(r.subsystem, r.channel, r.data, r.name) for r in got] == [(20, 0, [1, 2, 3], "ch00"), (20, 1, [1, 2, 3], "ch01")]
    assert got[0].time == 1_700_000_000.5 and got[0].frequency_hz == 600_000 and (got[0].lat, got[0].lon, got[0].heading, got[0].altitude) == (52.5, 4.02, 90, 8.5)
    index = jsf.ping_index(xtf.index_rows(xtf.read_xtf(spark, str(tmp_path), traces=False))).orderBy("rec_id").collect()
    assert [(r.rec_id, r.channel, r.validity, r.interval_ns, r.nsamples) for r in index] == [(0, 0, 73, 33_333_333, 3), (1, 1, 73, 33_333_333, 3)]
    assert xtf.packet_time(struct.pack("<H6B", 2023, 13, 1, 0, 0, 0, 0), 0) != xtf.packet_time(struct.pack("<H6B", 2023, 13, 1, 0, 0, 0, 0), 0)


def test_xtf_with_many_channels_and_a_short_last_packet(spark, tmp_path):
    (tmp_path / "line").mkdir()
    (tmp_path / "line" / "a.XTF").write_bytes(xtf_file(names=8, pings=40, samples=50)[:-7])
    rows = xtf.read_xtf(spark, str(tmp_path))
    assert rows.count() == 39 * 8 and rows.where("number = 7").first().frequency_hz == 900_000
    small = xtf.read_xtf(spark, str(tmp_path), size=3000)
    assert small.exceptAll(rows).count() == rows.exceptAll(small).count() == 0
    bands = spark.createDataFrame([("line", 20, 900_000.0 - 655_360), ("line", 21, 5.0), ("other", 20, 244_640.0)], "dataset string, subsystem int, recorded double")
    assert sorted((r.dataset, r.subsystem, r.centre) for r in xtf.scan_bands(spark, str(tmp_path), bands).collect()) == [("line", 20, 900_000.0), ("line", 21, 5.0), ("other", 20, 244_640.0)]


def plain_offsets(raw):
    """Offsets of all messages by one walk, and the place where sync was lost."""
    at, out = 0, []
    while at + 16 <= len(raw):
        if raw[at : at + 2] != b"\x01\x16":
            return out, at
        size = struct.unpack_from("<I", raw, at + 12)[0]
        if at + 16 + size > len(raw):
            break
        out.append(at)
        at += 16 + size
    return out, None


@pytest.mark.parametrize("tail", [b"", b"no header here at all", jsf_message(80, sonar_body([1]))[:200]])
def test_ranges_of_a_recording_are_one_walk(spark, tmp_path, tail):
    """Whatever the size of ranges, and with headers hidden in samples."""
    hidden = np.frombuffer(b"".join(jsf_message(80, bytes(240)) for _ in range(9)), "<i2")
    rng = np.random.default_rng(4)
    bodies = [hidden if k % 5 == 2 else rng.integers(-9, 9, rng.integers(1, 400)) for k in range(60)]
    raw = b"".join(jsf_message(80, sonar_body(b), 20 + k % 2, k % 2) for k, b in enumerate(bodies)) + tail
    (tmp_path / "a.jsf").write_bytes(raw + (jsf_message(80, sonar_body([5])) * 20 if tail.startswith(b"no") else b""))
    want, lost = plain_offsets((tmp_path / "a.jsf").read_bytes())
    for size in (700, 4096, 1 << 26):
        got = jsf.read_jsf(spark, str(tmp_path), size=size).collect()
        assert sorted(r.offset for r in got if r.warning is None) == want
        assert [r.warning for r in got if r.warning] == ([] if lost is None else [f"lost sync at byte {lost}"])


def test_a_recording_of_three_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    """Large padding between pings, as a file with holes; headers alone are fetched, and the places asked for."""
    from pyspark.sql import functions as F

    path, places, at = tmp_path / "a.jsf", [], 0
    ping = jsf_message(80, sonar_body([2, 4, 6] * 1000))
    with path.open("wb") as f:
        for k in range(48):
            for _ in range(3):
                f.seek(at)
                f.write(ping)
                places.append(at)
                at += len(ping)
            f.seek(at)
            f.write(struct.pack("<HBBHBBBBHI", 0x1601, 1, 0, 428, 0, 0, 0, 0, 0, 64 << 20))
            at += 16 + (64 << 20)
        f.seek(at)
        f.write(ping)
        places.append(at)
    assert path.stat().st_size > 3 << 30
    rows = jsf.read_jsf(spark, str(path), traces=False).withColumn("task", F.spark_partition_id())
    got = rows.select("offset", "task", "data").collect()
    assert sorted(r.offset for r in got) == places and len({r.task for r in got}) > 4 and all(r.data is None for r in got)
    file = ranged.Ranged(str(path))
    assert len(list(jsf.span_rows("a", file, 0, file.length, jsf.Wanted(traces=False)))) == len(places)
    assert file.fetched < len(places) * 300 + 48 * 16 + 16
    file = ranged.Ranged(str(path))
    assert not list(jsf.span_rows("a", file, 0, file.length, jsf.Wanted(subsystems=(21,)))) and file.fetched == (len(places) + 48) * 16
    file = ranged.Ranged(str(path))
    assert not list(jsf.span_rows("a", file, 0, file.length, jsf.Wanted(until=1_700_000_000.0))) and file.fetched < len(places) * 300 + 48 * 16 + 16
    file = ranged.Ranged(str(path))
    assert [r["data"][:3].tolist() for o in places[-2:] for r in jsf.ping_at("a", file, o)] == [[1, 2, 3]] * 2 and file.fetched == 2 * len(ping)
    name = f"file:{path}"
    wanted = spark.createDataFrame([(name, o) for o in (places[0], places[70], places[70], places[-1], 17)] + [("file:/elsewhere.jsf", 0)], "path string, offset long")
    found = jsf.pings_at(spark, str(path), wanted).collect()
    assert sorted(r.offset for r in found) == [places[0], places[70], places[-1]] and all(len(r.data) == 3000 for r in found)


def test_gpx(spark, tmp_path):
    text = """<?xml version="1.0"?><gpx><wpt lat="52" lon="4"><name>A &amp; B</name></wpt><trk><name>run</name><trkseg><trkpt lat="52.1" lon="4.1"/><trkpt lat="999" lon="1"/>
    <trkpt lon='4.2' lat='52.2'><ele>-3.5</ele><time>2023-01-01T00:00:00Z</time></trkpt></trkseg></trk><rte><rtept lat="1" lon="2"/></rte></gpx>"""
    (tmp_path / "a.gpx").write_text(text)
    df = gpx.read_gpx(spark, str(tmp_path / "a.gpx"))
    got = df.collect()
    assert [(r.kind, r.lat, r.lon) for r in got] == [("waypoint", 52, 4), ("track", 52.1, 4.1), ("track", 52.2, 4.2), ("route", 1, 2)]
    assert got[0].name == "A & B" and got[1].line_name == "run" and got[2].ele == -3.5
    again = gpx.parse(gpx.documents(df.where("kind = 'track'")).first().gpx)
    assert [(p["lat"], p["lon"], p["line_name"]) for p in again] == [(52.1, 4.1, "run"), (52.2, 4.2, "run")]
    with pytest.raises(ValueError):
        gpx.parse("<kml/>")


def lzw(data):
    """A plain encoder: a clear code often enough that widths stay at nine bits."""
    bits = ""
    for at in range(0, len(data), 200):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[at : at + 200])
    bits += f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff(values, compression=1, predictor=1, order="<", rows=5, tile=None, photometric=1, palette=None, nodata=None, epsg=32631, scale=(0.5, 0.5), origin=(572000, 5824500)):
    values = values if values.ndim == 3 else values[:, :, None]
    h, w, bands = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    size = values.dtype.itemsize
    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, bands), values.dtype)
        padded[:h, :w] = values
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [values[at : at + rows] for at in range(0, h, rows)]
    blocks = []
    for part in parts:
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(values.dtype)
        data = part.astype(values.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            planes = part.astype(f">f{size}").view(np.uint8).reshape(len(part), -1, size).transpose(0, 2, 1).reshape(len(part), -1, bands)
            data = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
        blocks.append({1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100))}[compression](data))
    blob, offsets = b"", []
    for s in blocks:
        offsets.append(8 + len(blob))
        blob += s
    counts = [len(s) for s in blocks]
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [size * 8] * bands), (259, 3, [compression]), (262, 3, [photometric]), (277, 3, [bands]), (317, 3, [predictor]), (339, 3, [kind] * bands)]
    entries += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, counts)]
    entries += [(33550, 12, [*map(float, scale), 0.0]), (33922, 12, [0.0, 0, 0, *map(float, origin), 0]), (34735, 3, [1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])]
    entries += [(320, 3, palette)] if palette else []
    entries += [(42113, 2, nodata)] if nodata else []
    at = 8 + len(blob)
    extra, body = b"", b""
    base = at + 2 + 12 * len(entries) + 4
    for tag, t, v in sorted(entries):
        raw = v.encode() + b"\0" if t == 2 else struct.pack(f"{order}{len(v)}" + {3: "H", 4: "I", 12: "d"}[t], *v)
        if len(raw) > 4:
            field, extra = struct.pack(order + "I", base + len(extra)), extra + raw
        else:
            field = raw.ljust(4, b"\0")
        body += struct.pack(order + "HHI", tag, t, len(raw) if t == 2 else len(v)) + field
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + blob + struct.pack(order + "H", len(entries)) + body + b"\0" * 4 + extra


@pytest.mark.parametrize("compression, predictor, dtype, order", [(1, 1, "u1", "<"), (1, 1, "i2", ">"), (5, 1, "u1", "<"), (5, 2, "i2", "<"), (8, 3, "f4", "<"), (8, 2, "u2", ">"), (32773, 1, "f4", "<")])
def test_geotiff(spark, tmp_path, compression, predictor, dtype, order):
    values = (np.arange(13 * 9).reshape(13, 9) * 3 % 251).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff(values, compression, predictor, order))
    df = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"))
    got = {(r.row, r.col): r for r in df.collect()}
    assert len(got) == values.size and all(r.bands == [float(values[k])] for k, r in got.items())
    assert (got[0, 0].x, got[0, 0].y) == (572000.25, 5824499.75) and geotiff.GeoTiff(ranged.Ranged(str(tmp_path / "a.tif"))).epsg == 32631


@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("compression, predictor, dtype", [(1, 1, "u1"), (5, 3, "f4"), (8, 2, "i2"), (8, 3, "f8"), (32773, 1, "u4")])
def test_blocks_of_a_grid_have_the_sum_of_its_pixels(spark, tmp_path, monkeypatch, tile, compression, predictor, dtype):
    """137 by 91 pixels in strips and tiles; a block is a task; blocks beyond the most samples are several rows."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    values = (rng.random((91, 137)) * 250).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff(values, compression, predictor, tile=tile))
    blocks = geotiff.read_blocks(spark, str(tmp_path / "a.tif")).withColumn("task", F.spark_partition_id()).collect()
    n = 54 if tile else 19
    assert len({r.block for r in blocks}) == len({r.task for r in blocks}) == n
    assert sum(sum(r.samples) for r in blocks) == pytest.approx(float(values.astype("f8").sum()), rel=1e-9)
    picture = np.zeros(values.shape)
    for r in blocks:
        picture[r.row : r.row + r.height, r.col : r.col + r.width] = np.array(r.samples).reshape(r.height, r.width)
    assert (picture == values).all()
    head = geotiff.headers(spark, str(tmp_path)).first()
    assert (head.width, head.height, head.epsg, head.single_band) == (137, 91, 32631, True) and head.description.startswith("137x91 · 1 band · ")


def test_a_strip_without_compression_is_read_by_rows(spark, tmp_path, monkeypatch):
    values = np.arange(4000 * 300, dtype="u2").reshape(4000, 300)
    (tmp_path / "a.tif").write_bytes(tiff(values, rows=4000, predictor=2))
    monkeypatch.setattr(geotiff, "MOST_SAMPLES", 90_000)
    file = ranged.Ranged(str(tmp_path / "a.tif"))
    t = geotiff.GeoTiff(file)
    listed = list(t.pieces())
    assert len(listed) == 14 and file.fetched < 1000
    col, row, part = t.piece(*listed[-1])
    assert (row, part.shape) == (3900, (100, 300, 1)) and (part[:, :, 0] == values[3900:]).all() and file.fetched < 70_000


def test_colours(spark, tmp_path):
    rng = np.random.default_rng(3)
    rgba, deep = rng.integers(0, 256, (20, 30, 4)).astype("u1"), rng.integers(0, 65536, (20, 30, 4)).astype("u2")
    index, share = rng.integers(0, 6, (20, 30)).astype("u1"), rng.random((20, 30, 3)).astype("f4") * 1.2 - 0.1
    palette = [int(v) for v in rng.integers(0, 65536, 12)]
    whole = lambda rgb, alpha=None: np.concatenate([rgb, np.full((20, 30, 1), 255, "u1") if alpha is None else alpha], axis=2)
    mapped = np.array([[palette[i] >> 8, palette[4 + i] >> 8, palette[8 + i] >> 8] for i in range(4)] + [[0, 0, 0]] * 2, "u1")
    cases = {
        "rgba": (dict(values=rgba, photometric=2, compression=8, predictor=2), rgba),
        "deep": (dict(values=deep, photometric=2, tile=16, order=">"), (deep / 65535 * 255).astype("u1")),
        "palette": (dict(values=index, photometric=3, palette=palette), whole(mapped[index])),
        "float": (dict(values=share, photometric=2), whole(np.clip(share.astype("f8") * 255, 0, 255).astype("u1"))),
        "white": (dict(values=index, photometric=0), whole(np.repeat(255 - index[:, :, None], 3, axis=2))),
    }
    for name, (made, want) in cases.items():
        (tmp_path / f"{name}.tif").write_bytes(tiff(**made))
        picture = np.zeros((20, 30, 4), "u1")
        for r in geotiff.read_blocks(spark, str(tmp_path / f"{name}.tif"), colours=True).collect():
            picture[r.row : r.row + r.height, r.col : r.col + r.width] = np.array(r.colours, ">u4").view("u1").reshape(r.height, r.width, 4)
        assert (picture == want).all(), name
    seen = geotiff.pixels(geotiff.read_blocks(spark, str(tmp_path / "rgba.tif"), colours=True)).count()
    assert seen == (rgba[:, :, 3] > 0).sum()


def test_pixels_without_data(spark, tmp_path):
    values = np.array([[1.0, -9999.0, np.nan], [np.inf, 5.0, 6.0]], "f4")
    (tmp_path / "a.tif").write_bytes(tiff(values, nodata="-9999"))
    assert sorted((r.row, r.col, r.bands) for r in geotiff.read_geotiff(spark, str(tmp_path)).collect()) == [(0, 0, [1.0]), (1, 1, [5.0]), (1, 2, [6.0])]
    (tmp_path / "b.tif").write_bytes(b"no tiff at all")
    with pytest.raises(Exception, match="not a TIFF"):
        geotiff.headers(spark, str(tmp_path / "b.tif")).collect()


def test_lzw_with_a_growing_table():
    data = bytes(range(256)) * 12 + b"abcabcabc" * 900
    table, out, held = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    code, width = 258, 9
    for b in data:
        if held + bytes([b]) in table:
            held += bytes([b])
            continue
        out.append((table[held], width))
        table[held + bytes([b])] = code
        code += 1
        width = 9 if code < 512 else 10 if code < 1024 else 11 if code < 2048 else 12
        if code >= 4094:
            out.append((256, width))
            table, code, width = {bytes([i]): i for i in range(256)}, 258, 9
        held = bytes([b])
    out += [(table[held], width), (257, width)]
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    assert geotiff.unlzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == data


def test_workspace_files(spark, tmp_path):
    from seabright.sources import catalogue, geojson

    for name in ("a/one.jsf", "a/two.xtf", "b/three.XTF", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 2)[-2:] for r in catalogue.sonar_files(spark, str(tmp_path)).collect()) == [["a", "one.jsf"], ["b", "three.XTF"]]
    index = spark.createDataFrame([("d", 1, 2.0), ("d", 0, 1.0), ("e", 0, 5.0)], "dataset string, rec_id long, time double")
    catalogue.save_index(index, str(tmp_path / "index"))
    assert sorted((r.dataset, r.rec_id, r.time) for r in catalogue.load_index(spark, str(tmp_path / "index")).collect()) == [("d", 0, 1.0), ("d", 1, 2.0), ("e", 0, 5.0)]
    cells = spark.createDataFrame([(5, 7, 1.5), (300, 2, 2.5)], "gx long, gy long, value double")
    catalogue.save_raster(cells, str(tmp_path / "raster"), {"zoom": 19, "version": "8"})
    got, header = catalogue.load_raster(spark, str(tmp_path / "raster"))
    assert header == {"zoom": 19, "version": "8"} and [(r.gx, r.value) for r in got.where("tx = 1").collect()] == [(300, 2.5)]
    contacts = spark.createDataFrame([("C002", "b", 52.0, 4.0), ("C001", "a", 51.0, 3.0)], "id string, name string, lat double, lon double")
    catalogue.save_contacts(contacts, str(tmp_path / "contacts"))
    assert [(r.id, r.name, r.lat, r.lon) for r in geojson.read_contacts(spark, str(tmp_path / "contacts")).orderBy("id").collect()] == [("C001", "a", 51.0, 3.0), ("C002", "b", 52.0, 4.0)]
    (tmp_path / "p.json").write_text('{"name": "n", "datasets": [{"name": "d", "enabled": true}], "view": {"z": "1"}, "later": 3}')
    project = catalogue.load_project(spark, str(tmp_path / "p.json"))
    catalogue.save_project(project, str(tmp_path / "out"))
    again = catalogue.load_project(spark, str(tmp_path / "out")).first()
    assert again.name == "n" and again.datasets[0].enabled and again.view == {"z": "1"} and again.layers is None


def test_pings_at_offsets(spark, tmp_path):
    one = jsf_message(80, sonar_body([2, 4]))
    (tmp_path / "a.jsf").write_bytes(one + jsf_message(80, sonar_body([8]), 21, 1))
    path = jsf.read_jsf(spark, str(tmp_path)).first().path
    wanted = spark.createDataFrame([(path, len(one)), (path, 5), (path, 10**6)], "path string, offset long")
    assert [(r.offset, r.subsystem, r.data) for r in jsf.pings_at(spark, str(tmp_path), wanted).collect()] == [(len(one), 21, [4.0])]
    assert jsf.index_degrees(31_500_000, 3) == 31.5 and jsf.index_degrees(31_500_000, 1) == 31.5 and np.isnan(jsf.degrees(1, 1))


def test_packets_take_their_index_without_a_join(spark):
    from seabright.plans import registry

    plan = registry.QUERIES["packet_pings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_tasks_follow_bytes_not_ranges(spark, tmp_path):
    """Many short ranges share tasks, and places asked for are dealt over several, however few bytes they are."""
    assert ranged.tasks_of(162_000, 10 << 30, 12) == 160 and ranged.tasks_of(3, 200, 8) == 3 and ranged.tasks_of(0, 0, 8) == 1
    raw = jsf_message(80, sonar_body([1, 2]))
    for k in range(40):
        (tmp_path / f"{k}.jsf").write_bytes(raw * 3)
    rows = jsf.read_jsf(spark, str(tmp_path), traces=False, size=300)
    assert rows.count() == 120 and rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert jsf.pings_at(spark, str(tmp_path), rows, size=300).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_document_is_read_by_pieces():
    """Points come while the text does, in pieces of any size; a name after the points of its line still counts."""
    point = '<trkpt lat="1" lon="2"><name>a &amp; b</name></trkpt>'
    late = f"<gpx><trk>{point * 3}<name>late</name></trk><trk><name>x</name>{point}</trk></gpx>"
    for size in (1, 7, 1000):
        got = list(gpx.points(late[k : k + size] for k in range(0, len(late), size)))
        assert got == gpx.parse(late) and [(p["line"], p["seq"], p["line_name"], p["name"]) for p in got] == [(0, 0, "late", "a & b"), (0, 1, "late", "a & b"), (0, 2, "late", "a & b"), (1, 0, "x", "a & b")]
    asked = []
    pieces = (asked.append(k) or p for k, p in enumerate(["<gpx><trk><name>x</name>", *[point] * 100]))
    next(gpx.points(pieces))
    assert len(asked) < 4
