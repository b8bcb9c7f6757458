"""What an image is measured and read with: column profiles, angle gain, extents, raster look-ups, tiles, readouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.functions.acoustics import altitude_valid, has_position, slant_range_m
from seabright.functions.arrays import smooth_clamped
from seabright.functions.geodesy import distance_m, local_scale, lonlat_to_px, wrap180
from seabright.operators.pings import upper_median_of


def column_profile(traces: DataFrame, width: int, strength: float = 0.7) -> DataFrame:
    """setting, profile: for each setting the divisor of each column, its median over all traces, floored at the 5th percentile of the positive ones, smoothed, to a power.

    ``traces``: setting, data (arrays of ``width`` amplitudes). Medians are aggregates by column; only ``width`` numbers a setting are gathered.
    """
    if strength <= 0:
        return traces.select("setting").distinct().withColumn("profile", F.array_repeat(F.lit(1.0), width))
    levels = traces.select("setting", F.posexplode("data").alias("col", "x")).groupBy("setting", "col").agg(F.percentile("x", F.lit(0.5)).alias("level"))
    rows = levels.groupBy("setting").agg(F.sort_array(F.collect_list(F.struct("col", "level"))).alias("l"), F.percentile(F.when(F.col("level") > 0, F.col("level")), F.lit(0.05)).alias("floor"))
    floored = F.transform("l", lambda s: F.greatest(s["level"], F.coalesce("floor", F.lit(0.0))))
    smooth = rows.select("setting", smooth_clamped(floored, max(width // 64, 3) | 1).alias("level"))
    return smooth.select("setting", F.transform("level", lambda x: F.greatest(F.pow(x, F.lit(strength)), F.lit(1e-9))).alias("profile"))


def angle_gain(samples: DataFrame, strength: float = 1.0, least: int = 20, by: tuple[str, ...] = ("side",)) -> DataFrame:
    """``by``, curve: 90 one-degree levels of ``samples`` (``by``, theta, amp), such as ``waterfall.angle_samples`` chooses: a bounded number of pings a recording.

    Bins of fewer than ``least`` samples, or of no level, take the one before, or else the one after; then floored at the 5th percentile, smoothed over 7, scaled to a median of one, to a power.
    """
    bins = samples.groupBy(*by, F.least(F.floor("theta"), F.lit(89)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.percentile("amp", F.lit(0.5)).alias("level"))
    every = samples.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(89))).alias("bin"))
    order = Window.partitionBy(*by).orderBy("bin")
    back = Window.partitionBy(*by).orderBy(F.desc("bin"))
    grown = Window.unboundedPreceding, 0
    rows = every.join(bins.where((F.col("n") >= least) & (F.col("level") > 0)), [*by, "bin"], "left")
    rows = rows.withColumn("level", F.coalesce(F.last("level", ignorenulls=True).over(order.rowsBetween(*grown)), F.last("level", ignorenulls=True).over(back.rowsBetween(*grown))))
    curves = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "level"))).alias("l"), F.percentile("level", F.lit(0.05)).alias("floor"))
    smooth = curves.select(*by, smooth_clamped(F.transform("l", lambda s: F.greatest(s["level"], F.col("floor"))), 7).alias("level"))
    ordered = F.array_sort("level")
    middle = (ordered[44] + ordered[45]) / 2
    shaped = F.transform("level", lambda x: F.pow(F.greatest(x / F.col("middle"), F.lit(1e-3)), F.lit(strength)))
    return smooth.withColumn("middle", middle).select(*by, F.when(F.col("middle") > 0, shaped).otherwise(F.array_repeat(F.lit(1.0), 90)).alias("curve"))


def angle_gain_at(curve: Column, theta: Column) -> Column:
    """A curve's value between bin middles, the ends held."""
    x = F.least(F.greatest(theta - 0.5, F.lit(0.0)), F.lit(89.0))
    i = F.least(F.floor(x), F.lit(88)).cast("int")
    return F.get(curve, i) + (F.get(curve, i + 1) - F.get(curve, i)) * (x - i)


def recorded_slant_m(nsamples: Column, interval_ns: Column, sound_speed: Column) -> Column:
    """Slant range by the speed of sound in the recording, 1500 where it gives none."""
    return nsamples * interval_ns * 1e-9 * F.when(sound_speed > 0, sound_speed).otherwise(1500.0) / 2


def steady_roll(roll: Column, most: float = 11.0) -> Column:
    """Whether a ping's roll leaves it clean."""
    return F.abs(roll) <= most


def in_look_window(bearing: Column, centre: float, width: float, turn_rate: Column | None = None, most_rate: float | None = None) -> Column:
    """Whether a stroke looks within ``width`` degrees of a bearing, and the ship turns slowly enough."""
    fits = F.abs(wrap180(bearing - centre)) <= width
    return fits if most_rate is None else fits & (F.abs(turn_rate) <= most_rate)


def median_altitude(pings: DataFrame, *by: str) -> DataFrame:
    """The upper median of the valid altitudes."""
    return pings.where(altitude_valid(F.col("validity"), F.col("altitude"))).groupBy(*by).agg(upper_median_of("altitude").alias("altitude"))


def beam_reach(pings: DataFrame, *by: str) -> DataFrame:
    """near_m, far_m: where the main beam falls to either side, between 32 and 82 degrees from nadir, and no farther than the traces reach."""
    reach = pings.withColumn("slant", slant_range_m(F.col("nsamples"), F.col("interval_ns"))).groupBy(*by).agg(upper_median_of("slant").alias("slant"))
    rows = median_altitude(pings, *by)
    rows = rows.join(reach, list(by)) if by else rows.crossJoin(reach)  # two rows of one
    ground = F.sqrt(F.greatest(F.col("slant") * F.col("slant") - F.col("altitude") * F.col("altitude"), F.lit(0.0)))
    return rows.select(*by, (F.col("altitude") * math.tan(math.radians(32))).alias("near_m"), F.least(ground, F.col("altitude") * math.tan(math.radians(82))).alias("far_m"))


def raster_extent(pings: DataFrame, zoom: int, tow_m: float, *by: str, slant: Column | None = None) -> DataFrame:
    """x0, y0, width, height of the raster that holds all traces: the box of positions, padded by 1.3 times the longest slant range and the tow."""
    valid = pings.where(has_position(F.col("lat"), F.col("lon")))
    box = valid.groupBy(*by).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.max(slant_range_m(F.col("nsamples"), F.col("interval_ns")) if slant is None else slant).alias("reach"))
    margin = (F.col("reach") + tow_m) * 1.3
    north, east = local_scale((F.col("s") + F.col("n")) / 2)
    box = box.withColumns({"dn": margin / north, "de": margin / east})
    x0, y1 = lonlat_to_px(F.col("w") - F.col("de"), F.col("s") - F.col("dn"), zoom)
    x1, y0 = lonlat_to_px(F.col("e") + F.col("de"), F.col("n") + F.col("dn"), zoom)
    return box.select(*by, F.floor(x0).alias("x0"), F.floor(y0).alias("y0"), (F.ceil(x1) - F.floor(x0) + 1).alias("width"), (F.ceil(y1) - F.floor(y0) + 1).alias("height"))


def sample_raster(cells: DataFrame, places: DataFrame, zoom: int) -> DataFrame:
    """``places`` (with lat, lon) with the value of the cell (gx, gy) of a raster that they lie in; null where there is none."""
    x, y = lonlat_to_px(F.col("lon"), F.col("lat"), zoom)
    return places.withColumns({"gx": F.floor(x), "gy": F.floor(y)}).join(cells.select("gx", "gy", "value"), ["gx", "gy"], "left")


def tile_pixels(cells: DataFrame, levels: int) -> DataFrame:
    """Pixels (gx, gy, value) of a zoom ``levels`` coarser: the whole part of the mean of the covered cells (gx, gy, value 0..255) on a grid of at most 16 by 16 in each.

    All cells of a pixel are not read where it is wider than 16: the reference's tiles are made so, and equal tiles are wanted here. For the full mean see ``mosaic.tile``.
    """
    step = 1 << levels
    every = max(step // min(step, 16), 1)
    inside = lambda c: F.pmod(F.col(c), F.lit(step)) % every == 0
    picked = cells.where(inside("gx") & inside("gy"))
    down = lambda c: F.floor(F.col(c) / step).alias(c)
    return picked.groupBy(down("gx"), down("gy")).agg(F.floor(F.sum("value") / F.count("*")).cast("int").alias("value"))


def metres_per_row(rows: DataFrame) -> DataFrame:
    """dataset, metres: the upper median of the positive distances between rows (dataset, row, lat, lon)."""
    order = Window.partitionBy("dataset").orderBy("row")
    steps = rows.withColumn("step", distance_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")))
    return steps.where("step > 0").groupBy("dataset").agg(upper_median_of("step").alias("metres"))


def time_model(rows: DataFrame) -> DataFrame:
    """dataset, row0, time0, seconds: the straight line of time over rows (dataset, row, time) through the first and the last."""
    ends = rows.groupBy("dataset").agg(F.min_by(F.struct("row", "time"), "row").alias("a"), F.max_by(F.struct("row", "time"), "row").alias("b"))
    span = F.col("b.row") - F.col("a.row")
    return ends.select("dataset", F.col("a.row").alias("row0"), F.col("a.time").alias("time0"), F.when(span > 0, (F.col("b.time") - F.col("a.time")) / span).otherwise(0.0).alias("seconds"))


def row_of_time(at: Column, row0: Column, time0: Column, seconds: Column) -> Column:
    """The row, with its fraction, of an instant by a time model; beyond the ends too."""
    return F.when(seconds > 0, row0 + (at - time0) / seconds).otherwise(row0)


def nice_distance(metres: Column) -> Column:
    """The largest of 1, 2 and 5 times a power of ten that is no longer."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(metres)))
    part = metres / power
    return F.when(part >= 5, 5.0).when(part >= 2, 2.0).otherwise(1.0) * power


def newest(files: DataFrame, keep: int, *by: str) -> DataFrame:
    """The ``keep`` files (with modified) last modified of each group, the greater path first among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def draw_order(layers: DataFrame) -> DataFrame:
    """Layers (place, kind, ...) from the first drawn to the last: tiles before vectors, each from the bottom of the list up."""
    return layers.withColumn("drawn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("kind") == "tiles", 0).otherwise(1), F.desc("place"))))


def merged_bands(bands: DataFrame) -> DataFrame:
    """subsystem, centre: over recordings (place, subsystem, centre), the first known centre, zero where none is."""
    known = F.when(F.col("centre") > 0, F.struct("place", "centre"))
    return bands.groupBy("subsystem").agg(F.coalesce(F.min(known)["centre"], F.lit(0.0)).alias("centre"))


def centroid(targets: DataFrame, *by: str) -> DataFrame:
    return targets.groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def in_frame(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres about a reference place."""
    north, east = local_scale(lat0)
    return (lon - lon0) * east, (lat - lat0) * north


def count_features(document: Column) -> Column:
    """Features in a GeoJSON text, zero where it is none."""
    return F.coalesce(F.size(F.from_json(F.get_json_object(document, "$.features"), "array<string>")), F.lit(0))


def parsed_coordinate(text: Column, latitude: bool) -> Column:
    """Degrees from a decimal, degrees and minutes, degrees, minutes and seconds, or a plotter's figures (5125.23 is 51 degrees 25.23 minutes), with a minus or a letter of N, S, E, W.

    Null for anything else: N or S in a longitude, sixty minutes, a place beyond the poles or the date line.
    """
    said = F.upper(F.trim(text))
    letter = F.regexp_extract(said, "[NSEW]", 0)
    wrong = (letter != "") & (letter.isin("N", "S") != F.lit(latitude))
    bare = F.trim(F.regexp_replace(said, "[NSEW]", " "))
    minus = bare.startswith("-")
    body = F.trim(F.when(minus, F.substring(bare, 2, 1 << 20)).otherwise(bare))
    parts = F.filter(F.split(body, "[\\s\u00a0°'′\"″:]+"), lambda x: x != "")
    number = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("double"), F.lit(0.0))
    whole, rest = F.substring_index(F.get(parts, F.lit(0)), ".", 1), F.regexp_extract(F.get(parts, F.lit(0)), r"(\.\d+)$", 1)
    long = F.char_length(whole) - 2
    minutes = F.concat(F.substring(whole, long + 1, F.lit(2)), rest).try_cast("double")
    compact = F.when(minutes < 60, F.substring(whole, F.lit(1), long).try_cast("double") + minutes / 60)
    single = F.when(F.char_length(whole) >= 4, compact).otherwise(number(0))
    several = F.when((number(1) < 60) & (number(2) < 60), number(0) + number(1) / 60 + number(2) / 3600)
    size = F.when(F.size(parts) >= 2, several).otherwise(single)
    fits = ~wrong & (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"^\d+(\.\d+)?$")) & (size <= (90 if latitude else 180))
    away = minus != letter.isin("S", "W")
    return F.when(fits, F.when(away, -size).otherwise(size))


def bridge_coordinate(value: Column, latitude: bool) -> Column:
    """Degrees and minutes as a bridge reads them: N5125.2300, E00309.3400; empty for no number."""
    size = F.abs(value)
    degrees = F.floor(size)
    letter = F.when(value < 0, "S" if latitude else "W").otherwise("N" if latitude else "E")
    return F.when(value.isNull() | F.isnan(value), "").otherwise(F.format_string("%s%0" + ("2" if latitude else "3") + "d%07.4f", letter, degrees, (size - degrees) * 60))


def fixed(value: Column, unit: float, places: int) -> Column:
    """A number from zero up in a unit with so many decimal places, halves of the last rounded up."""
    n = F.floor((value * 10**places + unit / 2) / unit)
    return n.cast("string") if not places else F.format_string(f"%d.%0{places}d", F.floor(n / 10**places), n % 10**places)


def distance_text(metres: Column) -> Column:
    """Kilometres, metres or centimetres, with as many places as mean something."""
    out = F.concat(fixed(metres * 100, 1.0, 0), F.lit(" cm"))
    for least, unit, places, name in ((1, 1.0, 1, " m"), (100, 1.0, 0, " m"), (1000, 1000.0, 2, " km"), (10_000, 1000.0, 0, " km")):
        out = F.when(metres >= least, F.concat(fixed(metres, unit, places), F.lit(name))).otherwise(out)
    return out


def chart_size(south: Column, west: Column, north: Column, east: Column, long: int = 1600) -> Column:
    """Struct (width, height) of a chart in the shape of its box, at most twice as long as wide; square for no box."""
    y = lambda lat: F.log(F.tan(math.pi / 4 + lat * (math.pi / 360)))
    wide, high = F.radians(east - west), y(north) - y(south)
    shape = F.least(F.greatest(F.when((wide > 0) & (high > 0), wide / high).otherwise(1.0), F.lit(0.5)), F.lit(2.0))
    side = lambda v: F.greatest(F.floor(v + 0.5), F.lit(1)).cast("int")
    return F.struct(F.when(shape >= 1, F.lit(long)).otherwise(side(long * shape)).cast("int").alias("width"), F.when(shape >= 1, side(long / shape)).otherwise(F.lit(long)).cast("int").alias("height"))
