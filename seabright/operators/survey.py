"""A recording's mosaic from its pings: navigation, absorption, angle gain, look window and painting in Web Mercator pixels, as one job for any number of recordings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seabright.functions import geodesy as geo
from seabright.functions.acoustics import absorption_db_per_km, altitude_valid, has_position, temperature_from_sound_speed
from seabright.operators import imaging, mosaic, navigation, rows, waterfall
from seabright.operators.pings import select_pings
from seabright.operators.quantiles import quantiles
from seabright.operators.stored import stored

C_RECORDED = 1500.0
#: Cells of a recording's raster at most.
MOST_CELLS = 400_000_000


@dataclass(frozen=True)
class Tow:
    """How the fish follows the ship, and where it points."""

    layback_m: float = 44.0
    gps_to_towpoint_m: float = 10.0
    model: str = "astern"  # astern, wake or tractrix
    bearing: str = "cog"  # cog or compass
    heading_offset: float = 0.0
    baseline_s: float = 12.0
    compass_s: float = 2.0
    most_roll: float = 11.0

    @property
    def back_m(self) -> float:
        return self.layback_m + self.gps_to_towpoint_m


@dataclass(frozen=True)
class Picture:
    """How a mosaic is made."""

    subsystem: int = 20
    zoom: int = 19
    sound_speed: float = 1500.0
    salinity: float = 35.0
    centre_hz: float = 0.0  # zero: as the pings recorded it
    across: int = 1024
    table: str = "outer"
    tvg: float = 0.7
    agc: float = 0.5
    angular: float = 0.7
    nadir_blank_m: float = 0.0
    max_range_m: float = 0.0
    drop_flagged: bool = True
    look: tuple[float, float] | None = None  # centre and width in degrees
    most_turn: float | None = None
    speckle: float = 0.0
    db: bool = False
    gamma: float = 0.8
    low: float = 1.0
    high: float = 99.0
    tow: Tow = field(default_factory=Tow)


def fixes(pings: DataFrame, tow: Tow = Tow()) -> DataFrame:
    """dataset, rec_id, time, lat, lon (of the fish), bearing, cog, speed, rate (degrees a second) and clean of every ping (dataset, rec_id, time, lat, lon, heading, roll) of recordings with positions."""
    known = pings.where(has_position(F.col("lat"), F.col("lon")))
    kept = navigation.fix_track(known).select("dataset", F.col("rec_id").alias("seq"), "time", "lat", "lon")
    track = stored(navigation.track(kept, tow.baseline_s), "track")
    probes = pings.select("dataset", "rec_id", "time", "roll")
    values, series = ["lat", "lon", "cog", "sog", "dist"], track
    if tow.model == "tractrix":
        series = stored(navigation.tractrix(track, tow.layback_m, tow.gps_to_towpoint_m), "tractrix")
        values = [*values, "fish_lat", "fish_lon"]
    at = stored(navigation.interpolate(series.select("dataset", "time", *values), probes, "time", values, "dataset"), "fixes")
    if tow.model == "tractrix":
        lat, lon = F.col("fish_lat_at"), F.col("fish_lon_at")
    elif tow.model == "wake":
        steps = track.groupBy("dataset", "dist").agg(F.max_by("lat", "seq").alias("back_lat"), F.max_by("lon", "seq").alias("back_lon"))
        behind = at.withColumn("dist", F.col("dist_at") - tow.back_m)
        at = navigation.interpolate(steps, behind, "dist", ["back_lat", "back_lon"], "dataset")
        lat, lon = F.col("back_lat_at"), F.col("back_lon_at")
    else:
        lat, lon = geo.offset_m(F.col("lat_at"), F.col("lon_at"), F.col("cog_at") + 180, F.lit(tow.back_m))
    turning = navigation.turn_rate_at(track, pings.select("dataset", F.col("rec_id").alias("probe"), "time")).select("dataset", F.col("probe").alias("rec_id"), "rate")
    out = at.join(turning, ["dataset", "rec_id"])
    way = F.col("cog_at")
    if tow.bearing == "compass":
        pointing = navigation.compass(pings.select("dataset", "rec_id", "time", "heading"), tow.compass_s).withColumnRenamed("heading", "pointing")
        out = out.join(pointing, ["dataset", "time"], "left")
        way = F.coalesce("pointing", "cog_at")
    bearing = F.pmod(way + tow.heading_offset, F.lit(360.0))
    return out.select("dataset", "rec_id", "time", lat.alias("lat"), lon.alias("lon"), bearing.alias("bearing"), F.pmod("cog_at", F.lit(360.0)).alias("cog"), F.col("sog_at").alias("speed"), "rate", imaging.steady_roll(F.col("roll"), tow.most_roll).alias("clean"))


def absorption(pings: DataFrame, picture: Picture) -> float:
    """Decibels a metre at the band's frequency and the temperature that the speed of sound tells; zero where no frequency is known."""
    if picture.tvg <= 0:
        return 0.0
    depth = quantiles(pings.where("depth > 0"), "depth", {"depth": 0.5}).first()["depth"]
    centre = picture.centre_hz
    if centre <= 0:
        centre = quantiles(pings.where("f0 > 0").withColumn("centre", (F.col("f0") + F.col("f1")) / 2), "centre", {"centre": 0.5}, rule="upper").first()["centre"] or 0.0
    if centre <= 0:
        return 0.0
    depth = 10.0 if depth is None else depth
    warm = temperature_from_sound_speed(picture.sound_speed, picture.salinity, depth)
    spark = pings.sparkSession
    return spark.range(1).select((absorption_db_per_km(F.lit(centre / 1000), warm, picture.salinity, depth) / 1000).alias("a")).first()["a"]


def extents(pings: DataFrame, picture: Picture) -> DataFrame:
    """dataset, x0, y0, width, height of each recording's raster; a recording whose raster is larger than ``MOST_CELLS`` fails the job: lower the zoom."""
    reach = F.col("nsamples") * F.col("interval_ns") * 1e-9 * picture.sound_speed / 2
    box = imaging.raster_extent(pings, picture.zoom, picture.tow.back_m, "dataset", slant=F.least(reach, F.lit(picture.max_range_m)) if picture.max_range_m else reach)
    cells = F.col("width") * F.col("height")
    return box.withColumn("width", F.when(cells > MOST_CELLS, F.raise_error(F.format_string("raster would be %sx%s; lower the zoom", "width", "height"))).otherwise(F.col("width")))


def paired(pings: DataFrame, traces: DataFrame, picture: Picture, interval: float | None = None) -> DataFrame:
    """The rows that ``mosaic.build`` paints: pairs of traces about the fish in pixels, with bearing, resolution, altitude and whether they are usable.

    A pair is where its port ping is, or its starboard one where there is none. Flagged pings are left out; pairs outside the look window or in a turn break the strip.
    """
    own = select_pings(pings, picture.subsystem)
    solved = fixes(own, picture.tow)
    pairs = rows.pair_channels(pings, picture.subsystem, interval).withColumn("rec_id", F.coalesce("port_id", "stbd_id"))
    told = own.select("dataset", "rec_id", "interval_ns", F.when(altitude_valid(F.col("validity"), F.col("altitude")), F.col("altitude")).alias("altitude"))
    out = pairs.join(told, ["dataset", "rec_id"]).join(solved, ["dataset", "rec_id"])
    if picture.drop_flagged:
        out = out.where("clean")
    out = out.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    looks: Column = F.lit(True)
    if picture.look is not None:
        looks = looks & imaging.in_look_window(F.col("bearing"), *picture.look)
    if picture.most_turn is not None:
        looks = looks & (F.abs("rate") <= picture.most_turn)
    x, y = geo.lonlat_to_px(F.col("lon"), F.col("lat"), picture.zoom)
    resolution = F.greatest(F.col("interval_ns") * 1e-9 * picture.sound_speed / 2, F.lit(1e-6))
    out = out.select(
        "dataset", "row", "port_id", "stbd_id", "bearing", looks.alias("usable"), x.alias("x"), y.alias("y"), (1 / geo.mercator_scale(F.col("lat"), picture.zoom)).alias("pixels_per_m"),
        resolution.alias("resolution_m"), (F.col("altitude") * picture.sound_speed / C_RECORDED).alias("altitude_m"),
    )
    return waterfall.with_priors(rows.with_traces(out, traces))


def build(pings: DataFrame, traces: DataFrame, picture: Picture = Picture(), interval: float | None = None) -> DataFrame:
    """gx, gy, value, grey, cover: the mosaic of a survey in Web Mercator pixels of ``picture.zoom``. ``pings`` are index rows of all bands (dataset, rec_id, ...), ``traces`` have rec_id (unique in the survey) and data."""
    own = select_pings(pings, picture.subsystem)
    extents(own, picture).write.format("noop").mode("overwrite").save()  # fails where a raster is too large
    alpha = absorption(own, picture)
    lines = stored(paired(pings, traces, picture, interval), "paired-rows")
    angle = None
    if picture.angular > 0:
        sampled = waterfall.angle_samples(lines, picture.across, picture.tvg, alpha, picture.nadir_blank_m, picture.max_range_m)
        angle = stored(imaging.angle_gain(sampled, picture.angular, by=("dataset", "side")), "angle-gain")
    return mosaic.build(
        lines, picture.across, picture.table, picture.agc, picture.tvg, alpha, picture.nadir_blank_m, picture.max_range_m, angle, picture.speckle, picture.db, picture.gamma, picture.low, picture.high
    )
