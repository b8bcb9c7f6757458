"""Imported grids and pictures as sparse cells in Web Mercator: resampling, statistics, codes, shaded relief, tiles of all zooms.

A source pixel is painted over the cells from its middle to those of its neighbours to the right and below, so a grid that is finer one way than the other leaves no stripes. Values of a
cell are averaged; of colours the pixel that comes last in the file stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.functions import geodesy as geo
from seabright.functions.acoustics import quantise
from seabright.operators.mosaic import RAMPS, hillshade
from seabright.operators.quantiles import quantiles
from seabright.operators.stored import stored
from seabright.sources import geotiff
from seabright.sources.png import encode

TILE = 256
#: Cells of an imported raster at most; beyond, its zoom is lowered.
MOST_CELLS = 268_435_456
#: Levels of a pyramid that one task makes of the cells of a tile.
LEVELS = 8


def zoom_for(metres: float, lat: float, most: int = 22) -> int:
    """The zoom whose pixels are at most ``metres`` wide at a latitude."""
    return min(max(math.ceil(math.log2(2 * math.pi * geo.MERCATOR_RADIUS / 256 * math.cos(math.radians(lat)) / metres)), 1), most)


@dataclass(frozen=True)
class Frame:
    """Where an imported raster lies: its first cell at ``zoom``, its size, and the box about the middles of its corner pixels."""

    epsg: int
    zoom: int
    x0: int
    y0: int
    width: int
    height: int
    south: float
    west: float
    north: float
    east: float


def raster_frame(spark: SparkSession, epsg: int, affine: list[float], width: int, height: int, zoom: int | None = None, most_cells: int = MOST_CELLS) -> Frame:
    """The frame of a raster: the zoom whose cells are no coarser than the finest side of its first pixel, lowered until there are no more than ``most_cells``."""
    a, b, c, d, e, f = affine
    middle = lambda col, row: (a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f)
    spots = [(0, 0), (width - 1, 0), (0, height - 1), (width - 1, height - 1), (1, 0), (0, 1)]
    rows = spark.createDataFrame([(i, *map(float, middle(*p))) for i, p in enumerate(spots)], "i int, x double, y double").coalesce(1)
    lat, lon = geo.to_wgs84(epsg, F.col("x"), F.col("y"))
    at = {r.i: (r.lat, r.lon) for r in rows.select("i", lat.alias("lat"), lon.alias("lon")).collect()}
    if any(v is None or not math.isfinite(v) for place in at.values() for v in place):
        raise ValueError("the georeferencing does not resolve to a position on the earth")
    lats, lons = [at[i][0] for i in range(4)], [at[i][1] for i in range(4)]
    south, north, west, east = min(lats), max(lats), min(lons), max(lons)

    def apart(p: tuple[float, float], q: tuple[float, float]) -> float:
        phi = math.radians((p[0] + q[0]) / 2)
        w = 1 - geo.WGS84.e2 * math.sin(phi) ** 2
        per = math.radians(1) * geo.WGS84.a
        return math.hypot((q[0] - p[0]) * per * (1 - geo.WGS84.e2) / w**1.5, (q[1] - p[1]) * per * math.cos(phi) / math.sqrt(w))

    def pixel(lon: float, lat: float, zoom: int) -> tuple[float, float]:
        size = 256.0 * 2**zoom
        return (lon + 180) / 360 * size, (0.5 - math.atanh(math.sin(math.radians(lat))) / (2 * math.pi)) * size

    if zoom is None:
        zoom = zoom_for(max(min(apart(at[0], at[4]), apart(at[0], at[5])), 1e-6), (south + north) / 2)
    while True:
        (x0, y1), (x1, y0) = pixel(west, south, zoom), pixel(east, north, zoom)
        left, top = math.floor(x0), math.floor(y0)
        across, down = math.ceil(x1) - left + 1, math.ceil(y1) - top + 1
        if across * down <= most_cells or zoom <= 1:
            return Frame(epsg, zoom, left, top, across, down, south, west, north, east)
        zoom -= 1


def footprints(pixels: DataFrame, frame: Frame, affine: list[float], width: int, height: int) -> DataFrame:
    """Every cell (gx, gy) that a pixel (col, row, ...) covers, with the pixel's place in the file as ``source``. Footprints are as wide as they are; cells outside the frame are left out."""
    a, b, c, d, e, f = affine

    def middle(col: Column, row: Column) -> tuple[Column, Column]:
        lat, lon = geo.to_wgs84(frame.epsg, (col + 0.5) * a + (row + 0.5) * b + c, (col + 0.5) * d + (row + 0.5) * e + f)
        return geo.lonlat_to_px(lon, lat, frame.zoom)

    col, row = F.col("col"), F.col("row")
    (px, py), (right, _), (_, below) = middle(col, row), middle(col + 1, row), middle(col, row + 1)
    one = F.lit(1).cast("long")
    wide = F.when(col + 1 < width, F.greatest(F.ceil(F.abs(right - F.col("px"))), one)).otherwise(one)
    high = F.when(row + 1 < height, F.greatest(F.ceil(F.abs(below - F.col("py"))), one)).otherwise(one)
    placed = pixels.withColumns({"px": px, "py": py}).withColumns({"wide": wide, "high": high, "left": F.floor("px"), "top": F.floor("py"), "source": row * width + col})
    kept = [n for n in pixels.columns if n not in ("col", "row")]
    cells = placed.select(*kept, "source", "top", "high", F.explode(F.sequence("left", F.col("left") + F.col("wide") - 1)).alias("gx"))
    cells = cells.select(*kept, "source", "gx", F.explode(F.sequence("top", F.col("top") + F.col("high") - 1)).alias("gy"))
    return cells.where(F.col("gx").between(frame.x0, frame.x0 + frame.width - 1) & F.col("gy").between(frame.y0, frame.y0 + frame.height - 1))


def mean_cells(covered: DataFrame, value: str = "value") -> DataFrame:
    """gx, gy, value, n: the mean of the pixels that cover each cell."""
    return covered.groupBy("gx", "gy").agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def last_cells(covered: DataFrame, colour: str = "colour") -> DataFrame:
    """gx, gy, r, g, b, a: of the pixels that cover each cell the one that comes last in the file. A colour is one number, red highest; wholly transparent pixels are not there to begin with."""
    last = covered.groupBy("gx", "gy").agg(F.max(F.struct("source", F.col(colour).alias("c"))).alias("last"))
    part = lambda k: F.shiftright(F.col("last.c"), k).bitwiseAND(255).cast("int")
    return last.select("gx", "gy", part(24).alias("r"), part(16).alias("g"), part(8).alias("b"), part(0).alias("a"))


def import_tiff(spark: SparkSession, path: str, zoom: int | None = None, most_cells: int = MOST_CELLS) -> tuple[DataFrame, Frame]:
    """The cells of a file and where they lie: value and n of a single band, r, g, b and a of a picture. A file that names no system is in degrees."""
    head = geotiff.headers(spark, path).first()
    if head is None or head.affine is None:
        raise ValueError("the file does not say where it lies")
    frame = raster_frame(spark, head.epsg or 4326, list(head.affine), head.width, head.height, zoom, most_cells)
    pixels = geotiff.pixels(geotiff.read_blocks(spark, path, colours=not head.single_band))
    pixels = pixels.select("col", "row", F.get("bands", F.lit(0)).alias("value")) if head.single_band else pixels.select("col", "row", "colour")
    covered = footprints(pixels, frame, list(head.affine), head.width, head.height)
    return (mean_cells(covered) if head.single_band else last_cells(covered)), frame


def statistics(cells: DataFrame) -> DataFrame:
    """One row: least, greatest and number of cells, and the 2nd and 98th percentiles: the cells at the rounded places (n - 1) * p in order."""
    ends = cells.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("filled"))
    return ends.join(F.broadcast(quantiles(cells, "value", {"p2": 0.02, "p98": 0.98}, rule="nearest")))


def codes(cells: DataFrame) -> DataFrame:
    """gx, gy, code: values in 16 bits between the least and the greatest."""
    span = cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return cells.join(F.broadcast(span)).select("gx", "gy", quantise(F.col("value"), F.col("lo"), F.col("hi")).alias("code"))


def relief(cells: DataFrame, metres: float, exaggeration: float = 6.0) -> DataFrame:
    """gx, gy, value, shade: Lambert shade from the slopes between each cell's neighbours, 1 where a neighbour is missing.

    A cell tells its four neighbours its value, so that one shuffle by cell gathers them.
    """
    told = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    sent = cells.select("gx", "gy", "value", F.explode(told).alias("d"))
    seen = lambda dx, dy: F.max(F.when((F.col("d.dx") == dx) & (F.col("d.dy") == dy), F.col("value")))
    near = sent.groupBy((F.col("gx") + F.col("d.dx")).alias("gx"), (F.col("gy") + F.col("d.dy")).alias("gy")).agg(
        seen(0, 0).alias("value"), seen(1, 0).alias("w"), seen(-1, 0).alias("e"), seen(0, 1).alias("n"), seen(0, -1).alias("s")
    ).where("value is not null")
    shade = hillshade((F.col("e") - F.col("w")) / (2 * metres), (F.col("n") - F.col("s")) / (2 * metres), exaggeration=exaggeration)
    whole = F.col("w").isNotNull() & F.col("e").isNotNull() & F.col("n").isNotNull() & F.col("s").isNotNull()
    return near.select("gx", "gy", "value", F.when(whole, shade).otherwise(1.0).alias("shade"))


# ---- tiles of all zooms ---------------------------------------------------------------------------------------


def pyramid(cells: DataFrame, sums: list[str], count: str, zoom: int, least_zoom: int) -> DataFrame:
    """zoom, gx, gy, ``sums`` and ``count`` of the cells of ``zoom`` and of every coarser one down to ``least_zoom``, each the sum of all cells below it.

    The cells of a tile (65,536 at most) meet in one task, which makes the eight levels above them; what is coarser comes from the single pixels those leave.
    """
    names = ["gx", "gy", *sums, count]

    def rolled(part: pa.Table) -> pa.Table:
        gx, gy = part["gx"].to_numpy(), part["gy"].to_numpy()
        planes = np.zeros((len(sums) + 1, TILE, TILE))
        planes[:, gx % TILE, gy % TILE] = [part[c].to_numpy() for c in names[2:]]
        x0, y0, out = int(gx[0]) // TILE * TILE, int(gy[0]) // TILE * TILE, []
        for level in range(min(LEVELS, zoom - least_zoom) + 1):
            if level:
                planes = planes[:, 0::2] + planes[:, 1::2]
                planes = planes[:, :, 0::2] + planes[:, :, 1::2]
            i, j = np.nonzero(planes[-1])
            values = [pa.array(p[i, j]) for p in planes[:-1]]
            out.append(pa.table([pa.array(np.full(len(i), zoom - level, np.int32)), pa.array(i + (x0 >> level)), pa.array(j + (y0 >> level)), *values, pa.array(planes[-1][i, j].astype(np.int64))], names=["zoom", *names]))
        return pa.concat_tables(out)

    wide = [F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), *(F.col(c).cast("double").alias(c) for c in sums), F.col(count).cast("long").alias(count)]
    kinds = f"zoom int, gx long, gy long, {''.join(f'{c} double, ' for c in sums)}{count} long"
    fine = cells.select(*wide).where(F.col(count) > 0).groupBy(F.floor(F.col("gx") / TILE), F.floor(F.col("gy") / TILE)).applyInArrow(rolled, kinds)
    if zoom - least_zoom <= LEVELS:
        return fine
    fine = stored(fine, "pyramid")
    level = F.explode(F.sequence(F.lit(1), F.lit(zoom - LEVELS - least_zoom))).alias("level")
    rest = fine.where(F.col("zoom") == zoom - LEVELS).select("gx", "gy", *sums, count, level)
    coarse = rest.select(F.expr("shiftright(gx, level)").alias("gx"), F.expr("shiftright(gy, level)").alias("gy"), *sums, count, (F.lit(zoom - LEVELS) - F.col("level")).alias("zoom"))
    coarse = coarse.groupBy("zoom", "gx", "gy").agg(*(F.sum(c).alias(c) for c in sums), F.sum(count).alias(count))
    return fine.unionByName(coarse)


def with_rim(pixels: DataFrame, side: int = TILE) -> DataFrame:
    """``pixels`` (gx, gy, ...) with the tiles (tx, ty) that show them: their own, and each of the others that have them on the rim of one pixel about it."""
    tiles = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / side) for d in (-1, 0, 1))))
    return pixels.withColumn("tx", F.explode(tiles("gx"))).withColumn("ty", F.explode(tiles("gy")))


@dataclass(frozen=True)
class Style:
    """How values are shown: between ``low`` and ``high`` along a ramp, blended with the light on their relief by ``shade``."""

    low: float
    high: float
    ramp: str = "depth"
    reverse: bool = False
    shade: float = 0.55
    azimuth: float = 315.0
    elevation: float = 40.0
    exaggeration: float = 6.0


def _number(told: dict[str, str], name: str) -> float | None:
    try:
        return float(told[name])
    except (KeyError, ValueError):
        return None


def overlaid(style: Style, told: dict[str, str]) -> Style:
    """A style with what a request tells of it: ramp, reverse, min, max, shade, azimuth, elevation and exaggeration, each kept within its bounds. What is unknown or no number changes nothing."""
    change: dict[str, object] = {}
    if told.get("ramp") in RAMPS:
        change["ramp"] = told["ramp"]
    if "reverse" in told:
        change["reverse"] = told["reverse"] in ("1", "true")
    bounds = {"low": ("min", -math.inf, math.inf), "high": ("max", -math.inf, math.inf), "shade": ("shade", 0.0, 1.0), "azimuth": ("azimuth", -math.inf, math.inf), "elevation": ("elevation", 1.0, 89.0), "exaggeration": ("exaggeration", 0.0, math.inf)}
    for field, (name, least, most) in bounds.items():
        if (value := _number(told, name)) is not None:
            change[field] = min(max(value, least), most)
    return replace(style, **change)


def grey_limits(told: dict[str, str], low: int = 0, high: int = 255) -> tuple[int, int]:
    """The grey levels that a mosaic's ramp begins and ends at, with what a request tells of them (lo, hi)."""
    at = lambda name, other: other if (value := _number(told, name)) is None else int(min(max(value, 0.0), 255.0))
    return at("lo", low), at("hi", high)


def shades(values: np.ndarray, metres: float, style: Style) -> np.ndarray:
    """Light on the inner pixels of a grid (row, column) with a rim of one: 0 to 1. A slope with a missing neighbour is level that way."""
    inner = values[1:-1, 1:-1]
    east, south = values[1:-1, 2:] - values[1:-1, :-2], values[:-2, 1:-1] - values[2:, 1:-1]
    dx, dy = (np.where(np.isfinite(v), v, 0.0) / (2 * metres) * max(style.exaggeration, 0.0) for v in (east, south))
    az, el = math.radians(90 - style.azimuth), math.radians(style.elevation)
    light = (-dx * math.cos(az) * math.cos(el) - dy * math.sin(az) * math.cos(el) + math.sin(el)) / np.sqrt(dx * dx + dy * dy + 1)
    return np.where(np.isfinite(inner), np.clip(light, 0, 1), np.nan)


def shown(values: np.ndarray, metres: float, style: Style) -> np.ndarray:
    """Red, green, blue and alpha of the inner pixels of a grid with a rim of one; those without value are clear."""
    inner = values[1:-1, 1:-1]
    known = np.isfinite(inner)
    span = style.high - style.low if abs(style.high - style.low) >= 1e-12 else 1.0
    share = np.where(known, (inner - style.low) / span, 0.0)
    share = np.clip(1 - share if style.reverse else share, 0, 1)
    stops = np.array(RAMPS[style.ramp])
    out = np.zeros((*inner.shape, 4), np.uint8)
    rgb = np.stack([np.floor(np.interp(share, stops[:, 0], stops[:, k]) + 0.5) for k in (1, 2, 3)], axis=2)
    if style.shade > 0:
        lit = np.nan_to_num(shades(values, metres, style))
        rgb = rgb * np.clip(1 - style.shade + style.shade * lit * 1.6, 0, 1.6)[:, :, None]
    out[:, :, :3] = np.clip(rgb, 0, 255)
    out[:, :, 3] = 255
    out[~known] = 0
    return out


def pixel_metres(zoom: int, base_zoom: int, middle_row: int) -> float:
    """Metres that a pixel of a zoom covers at the latitude of a row of cells of another."""
    lat = math.atan(math.sinh(math.pi * (1 - 2 * middle_row / (256.0 * 2**base_zoom))))
    return max(2 * math.pi * geo.MERCATOR_RADIUS / (256.0 * 2**zoom) * math.cos(lat), 1e-6)


def _grids(part: pa.Table, column: str) -> tuple[int, int, int, np.ndarray]:
    """zoom, tx, ty and the values of a tile's pixels and rim (row, column); NaN where there is none."""
    zoom, tx, ty = (int(part[c][0].as_py()) for c in ("zoom", "tx", "ty"))
    grid = np.full((TILE + 2, TILE + 2), np.nan)
    grid[part["gy"].to_numpy() - ty * TILE + 1, part["gx"].to_numpy() - tx * TILE + 1] = part[column].to_numpy()
    return zoom, tx, ty, grid


def value_tiles(levels: DataFrame, style: Style, base_zoom: int, middle_row: int) -> DataFrame:
    """zoom, tx, ty, png of every tile of a ``pyramid`` of (sum, n) that holds a value: colours along the ramp with the relief's light at the tile's own scale, so that neighbouring tiles meet without a seam."""

    def paint(part: pa.Table) -> pa.Table:
        zoom, tx, ty, grid = _grids(part, "value")
        image = shown(grid, pixel_metres(zoom, base_zoom, middle_row), style)
        keep = bool(image[:, :, 3].any())
        return pa.table({"zoom": pa.array([zoom], pa.int32()), "tx": [tx], "ty": [ty], "png": pa.array([encode(image)], pa.binary())}).slice(0, int(keep))

    means = levels.select("zoom", "gx", "gy", (F.col("sum") / F.col("n")).alias("value"))
    return with_rim(means).groupBy("zoom", "tx", "ty").applyInArrow(paint, "zoom int, tx long, ty long, png binary")


def tile_light(levels: DataFrame, style: Style, base_zoom: int, middle_row: int) -> DataFrame:
    """zoom, gx, gy, value, light of every pixel of a ``pyramid`` of (sum, n): the numbers that ``value_tiles`` shows."""

    def light(part: pa.Table) -> pa.Table:
        zoom, tx, ty, grid = _grids(part, "value")
        lit = shades(grid, pixel_metres(zoom, base_zoom, middle_row), style)
        j, i = np.nonzero(np.isfinite(lit))
        return pa.table({"zoom": pa.array(np.full(len(i), zoom, np.int32)), "gx": i + tx * TILE, "gy": j + ty * TILE, "value": grid[j + 1, i + 1], "light": lit[j, i]})

    means = levels.select("zoom", "gx", "gy", (F.col("sum") / F.col("n")).alias("value"))
    return with_rim(means).groupBy("zoom", "tx", "ty").applyInArrow(light, "zoom int, gx long, gy long, value double, light double")


def colour_tiles(levels: DataFrame) -> DataFrame:
    """zoom, tx, ty, png of every tile of a ``pyramid`` of (r, g, b, a, n): the mean of the cells that are not clear, rounded down."""

    def paint(part: pa.Table) -> pa.Table:
        zoom, tx, ty = (int(part[c][0].as_py()) for c in ("zoom", "tx", "ty"))
        image = np.zeros((TILE, TILE, 4), np.uint8)
        n = part["n"].to_numpy()
        image[part["gy"].to_numpy() % TILE, part["gx"].to_numpy() % TILE] = np.stack([part[c].to_numpy() // n for c in "rgba"], axis=1)
        return pa.table({"zoom": pa.array([zoom], pa.int32()), "tx": [tx], "ty": [ty], "png": pa.array([encode(image)], pa.binary())})

    placed = levels.withColumns({"tx": F.floor(F.col("gx") / TILE), "ty": F.floor(F.col("gy") / TILE)})
    return placed.groupBy("zoom", "tx", "ty").applyInArrow(paint, "zoom int, tx long, ty long, png binary")
