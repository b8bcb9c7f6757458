"""Mosaics as sparse cell tables: accumulation, finishing, tiles, speckle, colours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.functions.acoustics import piecewise, shape_priority
from seabright.functions.arrays import upper_median
from seabright.operators.quantiles import quantiles
from seabright.operators.stored import stored

# Priority by angle from nadir, in degrees.
PRIORITY = {
    "outer": [(0.0, 0.0), (12.0, 0.0), (22.0, 0.30), (35.0, 0.80), (50.0, 1.0), (65.0, 1.0), (75.0, 0.85), (82.0, 0.55), (90.0, 0.30)],
    "nadir": [(0.0, 1.0), (20.0, 1.0), (40.0, 0.70), (60.0, 0.35), (80.0, 0.10), (90.0, 0.05)],
    "flat": [(0.0, 0.0), (12.0, 0.0), (20.0, 1.0), (90.0, 1.0)],
}

# Colour stops (share, red, green, blue).
RAMPS = {
    "grey": [(0.0, 16, 16, 18), (1.0, 244, 246, 248)],
    "depth": [(0.0, 8, 20, 60), (0.2, 12, 56, 120), (0.4, 22, 104, 168), (0.6, 64, 158, 190), (0.8, 140, 205, 205), (1.0, 222, 240, 226)],
    "terrain": [(0.0, 22, 60, 100), (0.35, 70, 140, 170), (0.5, 214, 214, 170), (0.65, 120, 160, 90), (0.85, 150, 120, 80), (1.0, 250, 250, 250)],
    "viridis": [(0.0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 145, 140), (0.75, 94, 201, 98), (1.0, 253, 231, 37)],
    "magma": [(0.0, 0, 0, 4), (0.25, 81, 18, 124), (0.5, 183, 55, 121), (0.75, 252, 137, 97), (1.0, 252, 253, 191)],
    "turbo": [(0.0, 48, 18, 59), (0.2, 40, 130, 220), (0.4, 50, 200, 160), (0.6, 180, 222, 44), (0.8, 250, 140, 40), (1.0, 122, 4, 3)],
    "ice": [(0.0, 8, 12, 30), (0.5, 58, 118, 158), (1.0, 232, 246, 252)],
    "amber": [(0.0, 12, 8, 4), (0.5, 168, 96, 26), (1.0, 255, 236, 190)],
}


def priority(theta: Column, table: str = "outer", exponent: float = 8.0) -> Column:
    return shape_priority(piecewise(theta, PRIORITY[table]), exponent)


def accumulate(samples: DataFrame) -> DataFrame:
    """gx, gy, sum, wgt, hits of samples (gx, gy, amp, pri); those without amplitude or priority are left out."""
    usable = samples.where((F.col("pri") > 0) & F.col("amp").isNotNull() & ~F.isnan("amp") & (F.abs("amp") < float("inf")))
    return usable.groupBy("gx", "gy").agg(F.sum(F.col("amp") * F.col("pri")).alias("sum"), F.sum("pri").alias("wgt"), F.least(F.count("*"), F.lit(65535)).alias("hits"))


def finish(cells: DataFrame, db: bool = False) -> DataFrame:
    """gx, gy, value (weighted mean), cover."""
    from seabright.functions.acoustics import decibels

    value = F.col("sum") / F.col("wgt")
    return cells.where("wgt > 0").select("gx", "gy", (decibels(value) if db else value).alias("value"), F.least("hits", F.lit(255)).alias("cover"))


def tile(cells: DataFrame, levels: int) -> DataFrame:
    """Pixels of a coarser zoom: the mean of the covered cells of each."""
    down = lambda c: F.shiftright(c, levels).alias(c)
    return cells.groupBy(down("gx"), down("gy")).agg(F.avg("value").alias("value"), F.max("cover").alias("cover"))


def magnify(cells: DataFrame, levels: int) -> DataFrame:
    """Pixels of a finer zoom: each cell repeated."""
    side = F.sequence(F.lit(0), F.lit((1 << levels) - 1))
    return (
        cells.withColumn("i", F.explode(side)).withColumn("j", F.explode(side))
        .select((F.col("gx") * (1 << levels) + F.col("i")).alias("gx"), (F.col("gy") * (1 << levels) + F.col("j")).alias("gy"), "value", "cover")
    )


def box_stats(cells: DataFrame, radius: int = 2, block: int = 64) -> DataFrame:
    """gx, gy, value, mean, var, n over the covered cells of the square about each cell.

    Cells go in blocks with a rim of ``radius``; a block is at most (block + 2 * radius) squared cells, whatever the raster.
    """
    near = lambda c: F.array_distinct(F.transform(F.array(*(F.lit(d) for d in (-radius, 0, radius))), lambda d: F.floor((F.col(c) + d) / block)))
    spread = cells.select("gx", "gy", "value", F.explode(near("gx")).alias("bx"), near("gy").alias("ys")).withColumn("by", F.explode("ys")).drop("ys")

    def window(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(rows["bx"].iloc[0]) * block - radius, int(rows["by"].iloc[0]) * block - radius
        side = block + 2 * radius
        sums = np.zeros((3, side, side))
        i, j, v = (rows["gx"] - x0).to_numpy(), (rows["gy"] - y0).to_numpy(), rows["value"].to_numpy(float)
        sums[0, i, j], sums[1, i, j], sums[2, i, j] = 1, v, v * v
        total = np.zeros((3, side + 1, side + 1))
        total[:, 1:, 1:] = sums.cumsum(1).cumsum(2)
        own = (i >= radius) & (i < side - radius) & (j >= radius) & (j < side - radius)
        i, j, v = i[own], j[own], v[own]
        a, b, c, d = i - radius, i + radius + 1, j - radius, j + radius + 1
        n, s, q = total[:, b, d] - total[:, a, d] - total[:, b, c] + total[:, a, c]
        mean = s / n
        return pd.DataFrame({"gx": i + x0, "gy": j + y0, "value": v, "mean": mean, "var": np.maximum(q / n - mean * mean, 0), "n": n.astype(np.int64)})

    return spread.groupBy("bx", "by").applyInPandas(window, "gx long, gy long, value double, mean double, var double, n long")


def despeckle(cells: DataFrame, strength: float = 1.0, radius: int = 2) -> DataFrame:
    """Lee filter over the covered cells; holes stay holes. The noise level is the tenth percentile of the local variation."""
    stats = stored(box_stats(cells.select(F.col("gx").cast("long"), F.col("gy").cast("long"), "value"), radius), "box-stats")
    noise = quantiles(stats.where("mean > 0 and var > 0").select((F.sqrt("var") / F.col("mean")).alias("noise")), "noise", {"cu": 0.1})
    k = F.when(F.col("var") > 0, F.least(F.greatest(1 - F.col("cu") * F.col("cu") * F.col("mean") * F.col("mean") / F.col("var"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    lee = F.col("mean") + k * (F.col("value") - F.col("mean"))
    return stats.join(F.broadcast(noise)).select("gx", "gy", (F.col("value") + strength * (F.coalesce(lee, F.col("value")) - F.col("value"))).alias("value"))


def equalise(levels: DataFrame, strength: float, reach: int = 20, at_least: int = 5, most: float = 4.0, sides: dict[str, str] | None = None) -> DataFrame:
    """Along-track gain of each stroke: (local upper median of the positive levels / its own) ** strength; one where it has no level, too few neighbours, or a gain outside sane limits.

    ``levels``: dataset, stroke and a level for each of ``sides`` (name of the level: name of its gain; level: gain unless told), all of which one pass goes through.
    """
    order = Window.partitionBy("dataset").orderBy(F.col("stroke").cast("long")).rangeBetween(-reach, reach)  # strokes that were not laid keep their places
    sides = sides or {"level": "gain"}
    near = {f"near_{level}": F.collect_list(F.when(F.col(level) > 0, F.col(level))).over(order) for level in sides}
    rows = levels.withColumns(near)
    for level, name in sides.items():
        gain = F.when((F.col(level) > 0) & (F.size(f"near_{level}") >= at_least), F.pow(upper_median(F.col(f"near_{level}")) / F.col(level), F.lit(strength)))
        rows = rows.withColumn(name, gain).withColumn(name, F.when(F.col(name).between(1 / most, most), F.col(name)).otherwise(F.lit(1.0)))
    return rows.drop(*near)


def bridge_steps(x0: Column, y0: Column, x1: Column, y1: Column, most: int) -> Column:
    """Shares at the middles of the steps, one a pixel and at most ``most``, from one place to another."""
    n = F.least(F.greatest(F.ceil(F.hypot(x1 - x0, y1 - y0)), F.lit(1)), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda s: (s + 0.5) / n)


def splat_line(strokes: DataFrame, most: int = 64) -> DataFrame:
    """gx, gy, amp, pri along each stroke: consecutive samples (x, y, amp, pri) joined by interpolated steps.

    ``strokes``: stroke, samples (array of structs in order across).
    """
    pairs = F.transform(F.sequence(F.lit(1), F.size("samples") - 1), lambda i: F.struct(F.get("samples", i - 1).alias("a"), F.get("samples", i).alias("b")))
    rows = strokes.where("size(samples) > 1").select("stroke", F.explode(pairs).alias("p")).select("stroke", "p.a", "p.b")
    rows = rows.withColumn("t", F.explode(bridge_steps(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"), most)))
    mix = lambda f: F.col(f"a.{f}") + (F.col(f"b.{f}") - F.col(f"a.{f}")) * F.col("t")
    return rows.select(F.floor(mix("x")).alias("gx"), F.floor(mix("y")).alias("gy"), mix("amp").alias("amp"), mix("pri").alias("pri"))


FIELDS = ("x", "y", "amp", "pri")


def _steps(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Points (x, y, amp, pri) at the middles of the steps between points of ``a`` and ``b`` (4 rows each): one a pixel and at most ``most``."""
    n = np.clip(np.ceil(np.hypot(b[0] - a[0], b[1] - a[1])), 1, most).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    t = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[of]
    return a[:, of] + (b - a)[:, of] * t


def _before(here: np.ndarray, across: np.ndarray, old: np.ndarray, gap: float) -> np.ndarray:
    """The earlier stroke's x, y, amp and pri at the distances ``here`` across; not a number outside it and over gaps in it."""
    if len(across) < 2:
        return np.full((4, len(here)), np.nan)
    i = np.searchsorted(across, here)
    j = np.clip(i, 1, len(across) - 1)
    share = (here - across[j - 1]) / np.maximum(across[j] - across[j - 1], 1e-9)
    share[(i == 0) | (i == len(across)) | (across[j] - across[j - 1] > gap)] = np.nan
    return old[:, j - 1] + (old[:, j] - old[:, j - 1]) * share


def stroke_points(across: np.ndarray, now: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None, most: int = 64, most_back: int = 16, farthest: float = 12.0, gap: float = 1.0) -> np.ndarray:
    """Points (x, y, amp, pri) that a stroke paints: its outermost port sample, which no step leads to, the steps across, and the steps from the stroke before it at the same distances across.

    Nothing is joined outside the earlier stroke, across a gap in it of more than ``gap`` metres, or over more than ``farthest`` pixels.
    """
    points = [now[:, :1], _steps(now[:, :-1], now[:, 1:], most)]
    if before is not None:
        back = _before(across, *before, gap)
        with np.errstate(invalid="ignore"):
            near = np.hypot(now[0] - back[0], now[1] - back[1]) <= farthest
        points.append(_steps(back[:, near], now[:, near], most_back))
    return np.concatenate(points, axis=1)


def cell_sums(points: np.ndarray) -> pd.DataFrame:
    """gx, gy, sum, wgt, hits of points (x, y, amp, pri); those without amplitude or priority are left out."""
    points = points[:, (points[3] > 0) & np.isfinite(points[2])]
    gx, gy = (np.floor(points[k]).astype(np.int64) for k in (0, 1))
    x0, y0 = gx.min(initial=0), gy.min(initial=0)
    cells, of = np.unique((gx - x0) * (int(gy.max(initial=0)) - y0 + 1) + gy - y0, return_inverse=True)
    tall = int(gy.max(initial=0)) - y0 + 1
    sums = [np.bincount(of, w, len(cells)) for w in (points[2] * points[3], points[3], None)]
    return pd.DataFrame({"gx": cells // tall + x0, "gy": cells % tall + y0, "sum": sums[0], "wgt": sums[1], "hits": sums[2].astype(np.int64)})


#: Strokes that one group paints, and points that are held before they are summed by cell (some 150 bytes each then; Spark adds up a task's sums before it shuffles them).
CHUNK, MOST_POINTS = 512, 200_000


def painted(batches):
    """Sums by cell of the strokes in frames of dataset, chunk, stroke, own, usable, gains and samples, which come in that order; of about ``MOST_POINTS`` points at a time."""
    group, before, held, size = None, None, [], 0
    for part in batches:
        for r in part.itertuples(index=False):
            if (r.dataset, r.chunk) != group:
                group, before = (r.dataset, r.chunk), None
            across, now = np.asarray(r.across), np.stack([getattr(r, f) for f in FIELDS])
            now[2] *= np.where(across < 0, r.port_gain, r.stbd_gain)
            if r.own and r.usable and len(across):
                held.append(stroke_points(across, now, before))
                size += held[-1].shape[1]
            before = (across, now) if r.usable else None
            if size > MOST_POINTS:
                yield cell_sums(np.concatenate(held, axis=1))
                held, size = [], 0
    if held:
        yield cell_sums(np.concatenate(held, axis=1))


def paint(laid: DataFrame, gains: DataFrame) -> DataFrame:
    """gx, gy, sum, wgt, hits of strokes: dataset, stroke, samples (across, x, y, amp, pri in order across), usable.

    ``gains`` has dataset, stroke, port_gain and stbd_gain. A stroke that is not usable is not painted and breaks the strip. Strokes go in chunks, each with the last stroke before it,
    and every chunk sums its own cells before any are shuffled.
    """
    order = Window.partitionBy("dataset").orderBy("stroke")
    chunk = F.floor(F.col("stroke") / CHUNK)
    told = gains.select("dataset", "stroke", "port_gain", "stbd_gain", chunk.alias("chunk"), F.floor(F.lead("stroke").over(order) / CHUNK).alias("next"))
    kept = F.array(F.struct(F.col("chunk"), F.lit(True).alias("own")), F.struct(F.col("next").alias("chunk"), F.lit(False).alias("own")))
    rows = laid.join(told, ["dataset", "stroke"]).withColumn("c", F.explode(F.when(F.col("next") > F.col("chunk"), kept).otherwise(F.slice(kept, 1, 1))))
    rows = rows.select("dataset", F.col("c.chunk").alias("chunk"), "stroke", F.col("c.own").alias("own"), "usable", "port_gain", "stbd_gain", *(F.col(f"samples.{f}").alias(f) for f in ("across", *FIELDS)))

    dealt = rows.repartition("dataset", "chunk").sortWithinPartitions("dataset", "chunk", "stroke")
    cells = dealt.mapInPandas(painted, "gx long, gy long, sum double, wgt double, hits long")
    return cells.groupBy("gx", "gy").agg(F.sum("sum").alias("sum"), F.sum("wgt").alias("wgt"), F.least(F.sum("hits"), F.lit(65535)).alias("hits"))


def build(rows: DataFrame, across: int = 1024, table: str = "outer", agc: float = 0.5, tvg: float = 0.7, alpha: float = 0.0, nadir_blank_m: float = 0.0, max_range_m: float = 0.0, angle: DataFrame | None = None, speckle: float = 0.0, db: bool = False, gamma: float = 0.8, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """gx, gy, value, grey, cover: the mosaic of paired traces in the pixels that x and y are in.

    ``rows`` are those of ``waterfall.strokes`` (with priors), and usable (boolean: roll, look window and turn rate are fit). Strokes are laid once into a table, equalised along the track side by side, painted across and
    back to the one before, averaged into a table, filtered if asked, and stretched between two exact percentiles of the painted cells.
    """
    from seabright.functions.acoustics import decibels, stretch
    from seabright.operators import waterfall

    rows = rows.withColumn("usable", F.coalesce("usable", F.lit(False)))
    laid = stored(waterfall.strokes(rows, across, table, tvg, alpha, nadir_blank_m, max_range_m, True, angle), "strokes")
    gains = equalise(laid.select("dataset", "stroke", "port_level", "stbd_level"), agc, sides={"port_level": "port_gain", "stbd_level": "stbd_gain"})
    cells = stored(finish(paint(laid.select("dataset", "stroke", "usable", "samples"), gains)), "cells")
    if speckle > 0:
        cells = stored(despeckle(cells, speckle).join(cells.select("gx", "gy", "cover"), ["gx", "gy"]), "filtered-cells")
    cells = cells.withColumn("scaled", decibels(F.col("value")) if db else F.col("value"))
    cut = quantiles(cells.where("scaled > 0"), "scaled", {"low": low / 100, "high": high / 100})
    return cells.join(F.broadcast(cut)).select("gx", "gy", "value", stretch(F.col("scaled"), F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0)), gamma).alias("grey"), "cover")


def colour(share: Column, ramp: str = "grey") -> Column:
    """Struct (r, g, b) of a share 0..1."""
    stops = RAMPS[ramp]
    band = lambda k: F.round(piecewise(share, [(s[0], s[k]) for s in stops])).cast("int")
    return F.struct(band(1).alias("r"), band(2).alias("g"), band(3).alias("b"))


def styled(grey: Column, low: int = 0, high: int = 255, reverse: bool = False, ramp: str = "grey") -> Column:
    share = F.least(F.greatest((grey - low) / float(max(high - low, 1)), F.lit(0.0)), F.lit(1.0))
    return colour(1 - share if reverse else share, ramp)


def hillshade(dx: Column, dy: Column, azimuth: float = 315.0, elevation: float = 40.0, exaggeration: float = 6.0) -> Column:
    """Lambert shade, 0..1.6, of a slope."""
    import math

    az, el = math.radians(azimuth), math.radians(elevation)
    gx, gy = dx * exaggeration, dy * exaggeration
    light = (-gx * math.sin(az) * math.cos(el) - gy * math.cos(az) * math.cos(el) + math.sin(el)) / F.sqrt(gx * gx + gy * gy + 1)
    return F.greatest(light, F.lit(0.0)) * 1.6
