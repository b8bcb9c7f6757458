import math

import numpy as np
import pytest
from test_sources import tiff

from seabright.functions import geodesy as geo
from seabright.operators import layers


def pixel(lon, lat, zoom):
    size = 256.0 * 2**zoom
    return (lon + 180) / 360 * size, (0.5 - math.atanh(math.sin(math.radians(lat))) / (2 * math.pi)) * size


def plain_import(values, a, e, x, y, zoom):
    """Cells of a raster in degrees: lists of the pixels over each, in the order of the file."""
    h, w = values.shape[:2]
    out = {}
    at = lambda c, r: pixel(x + a * (c + 0.5), y - e * (r + 0.5), zoom)
    for r in range(h):
        for c in range(w):
            px, py = at(c, r)
            nx = max(1, math.ceil(abs(at(c + 1, r)[0] - px))) if c + 1 < w else 1
            ny = max(1, math.ceil(abs(at(c, r + 1)[1] - py))) if r + 1 < h else 1
            for i in range(nx):
                for j in range(ny):
                    out.setdefault((math.floor(px) + i, math.floor(py) + j), []).append(values[r, c])
    return out


def test_import_of_values(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = rng.random((40, 30)).astype("f4") * 100
    values[3, 4] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(values, compression=8, nodata="-9999", epsg=4326, scale=(2e-5, 1e-5), origin=(4.0, 52.0)))
    cells, frame = layers.import_tiff(spark, str(tmp_path / "a.tif"))
    assert frame.zoom == 17 and frame.epsg == 4326  # 1.11 m a row
    want = {k: [float(p) for p in v if p != -9999] for k, v in plain_import(values, 2e-5, 1e-5, 4.0, 52.0, frame.zoom).items()}
    want = {k: v for k, v in want.items() if v and frame.x0 <= k[0] < frame.x0 + frame.width and frame.y0 <= k[1] < frame.y0 + frame.height}
    got = {(r.gx, r.gy): r for r in cells.collect()}
    assert set(got) == set(want) and all(got[k].n == len(v) and got[k].value == pytest.approx(np.mean(v)) for k, v in want.items())


def test_import_of_colours_keeps_the_last(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 256, (25, 35, 4)).astype("u1")
    values[rng.random((25, 35)) < 0.2, 3] = 0
    (tmp_path / "a.tif").write_bytes(tiff(values, photometric=2, tile=16, epsg=4326, scale=(1e-5, 1e-5), origin=(4.0, 52.0)))
    cells, frame = layers.import_tiff(spark, str(tmp_path / "a.tif"), zoom=19)
    want = {k: tuple(int(c) for c in [p for p in v if p[3]][-1]) for k, v in plain_import(values, 1e-5, 1e-5, 4.0, 52.0, 19).items() if any(p[3] for p in v)}
    got = {(r.gx, r.gy): (r.r, r.g, r.b, r.a) for r in cells.collect()}
    inside = {k: v for k, v in want.items() if frame.x0 <= k[0] < frame.x0 + frame.width and frame.y0 <= k[1] < frame.y0 + frame.height}
    assert got == inside and len(got) > 35 * 25


def test_zoom_is_lowered_to_the_most_cells(spark):
    args = (spark, 4326, [1e-5, 0.0, 4.0, 0.0, -1e-5, 52.0], 2000, 1000)
    full, small = layers.raster_frame(*args), layers.raster_frame(*args, most_cells=100_000)
    assert full.width * full.height > 100_000 >= small.width * small.height and small.zoom < full.zoom
    assert layers.raster_frame(*args, zoom=12).zoom == 12
    grid = layers.raster_frame(spark, 32631, [1.0, 0.0, 572_000.0, 0.0, -1.0, 5_824_500.0], 100, 100)
    assert 52.5 < grid.south < grid.north < 52.6 and grid.zoom == 17


def plain_levels(cells, zoom, least):
    out = {}
    for (x, y), value in cells.items():
        for z in range(zoom, least - 1, -1):
            out.setdefault((z, x >> zoom - z, y >> zoom - z), []).append(value)
    return out


def made_cells(seed=5):
    rng = np.random.default_rng(seed)
    return {(1000 + int(x), 2000 + int(y)): float(v) for x, y, v in zip(rng.integers(0, 700, 3000), rng.integers(0, 500, 3000), rng.random(3000) * 50, strict=True)}


@pytest.mark.parametrize("least", [10, 0])
def test_every_zoom_from_one_pass(spark, least):
    cells = made_cells()
    df = spark.createDataFrame([(x, y, v, 1) for (x, y), v in cells.items()], "gx int, gy int, sum double, n int")
    got = {(r.zoom, r.gx, r.gy): (r.sum, r.n) for r in layers.pyramid(df, ["sum"], "n", 12, least).collect()}
    want = plain_levels(cells, 12, least)
    assert set(got) == set(want) and all(got[k][1] == len(v) and got[k][0] == pytest.approx(sum(v)) for k, v in want.items())
    assert layers.pyramid(df.limit(0), ["sum"], "n", 12, least).count() == 0


def test_tiles_meet_without_a_seam(spark):
    """Light and colour of every pixel of every tile, and of its neighbours in other tiles, against a plain loop."""
    from seabright.sources.png import encode

    cells, style = made_cells(), layers.Style(5.0, 45.0, "terrain", shade=0.7)
    df = spark.createDataFrame([(x, y, v, 1) for (x, y), v in cells.items()], "gx int, gy int, sum double, n int")
    levels = layers.pyramid(df, ["sum"], "n", 12, 9)
    means = {k: sum(v) / len(v) for k, v in plain_levels(cells, 12, 9).items()}
    got = {(r.zoom, r.gx, r.gy): (r.value, r.light) for r in layers.tile_light(levels, style, 12, 2250).collect()}
    az, el = math.radians(-225), math.radians(40)

    def light(z, x, y):
        lat = math.atan(math.sinh(math.pi * (1 - 2 * 2250 / (256 * 2**12))))
        metres = 2 * math.pi * geo.MERCATOR_RADIUS / (256 * 2**z) * math.cos(lat)
        e, w, n, s = (means.get((z, x + i, y + j)) for i, j in ((1, 0), (-1, 0), (0, -1), (0, 1)))
        dx = (e - w) / (2 * metres) * 6 if None not in (e, w) else 0.0
        dy = (n - s) / (2 * metres) * 6 if None not in (n, s) else 0.0
        return min(max((-dx * math.cos(az) * math.cos(el) - dy * math.sin(az) * math.cos(el) + math.sin(el)) / math.sqrt(dx * dx + dy * dy + 1), 0), 1)

    assert set(got) == set(means)
    assert all(got[k][0] == pytest.approx(v) and got[k][1] == pytest.approx(light(*k)) for k, v in means.items())
    tiles = {(r.zoom, r.tx, r.ty): r.png for r in layers.value_tiles(levels, style, 12, 2250).collect()}
    assert set(tiles) == {(z, x // 256, y // 256) for z, x, y in means}
    stops = np.array(layers.RAMPS["terrain"])
    for (z, tx, ty), png in tiles.items():
        image = np.zeros((256, 256, 4), np.uint8)
        for (zoom, x, y), value in means.items():
            if (zoom, x // 256, y // 256) == (z, tx, ty):
                share = min(max((value - 5) / 40, 0), 1)
                lit = min(max(1 - 0.7 + 0.7 * got[zoom, x, y][1] * 1.6, 0), 1.6)
                image[y % 256, x % 256] = [*(min(int(math.floor(np.interp(share, stops[:, 0], stops[:, k]) + 0.5) * lit), 255) for k in (1, 2, 3)), 255]
        assert png == encode(image)


def test_colour_tiles(spark):
    from seabright.sources.png import encode

    rows = [(10, 10, 255, 0, 10, 255), (11, 10, 0, 1, 11, 255), (300, 9, 9, 9, 9, 100)]
    df = spark.createDataFrame([(*row, 1) for row in rows], "gx int, gy int, r int, g int, b int, a int, n int")
    got = {(r.zoom, r.tx, r.ty): r.png for r in layers.colour_tiles(layers.pyramid(df, ["r", "g", "b", "a"], "n", 3, 2)).collect()}
    assert set(got) == {(3, 0, 0), (3, 1, 0), (2, 0, 0)}
    image = np.zeros((256, 256, 4), np.uint8)
    image[5, 5], image[4, 150] = [127, 0, 10, 255], [9, 9, 9, 100]
    assert got[2, 0, 0] == encode(image)


def test_styles_take_what_a_request_tells():
    style = layers.Style(1.0, 9.0)
    got = layers.overlaid(style, {"ramp": "viridis", "reverse": "true", "min": "2.5", "max": "x", "shade": "7", "elevation": "0", "exaggeration": "-1", "other": "1"})
    assert got == layers.Style(2.5, 9.0, "viridis", True, 1.0, 315.0, 1.0, 0.0)
    assert layers.overlaid(style, {"ramp": "none", "reverse": "0"}) == style and layers.overlaid(style, {}) == style
    assert layers.grey_limits({"lo": "17.9", "hi": "999"}) == (17, 255) and layers.grey_limits({"hi": "-3"}, 5) == (5, 0) and layers.grey_limits({}) == (0, 255)
