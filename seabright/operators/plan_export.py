"""Plans as they leave the engine: steering points, GPX documents, and GeoJSON shapes.

All positions are those of the antenna, not of the towed fish. A plan's frame is metres along (v) and across (u) its azimuth about a reference place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seabright.functions.geodesy import local_scale
from seabright.operators.planner import Rig, Sonar, coverage, fish_short, gaps, unrotated
from seabright.sources import gpx

#: Metres from which the end of recording and the turn are two marks, and by which a drawn turn may miss its arc.
APART_M, TOLERANCE_M = 20.0, 1.0
POINTS = "array<struct<v: double, u: double>>"


def placed(u: Column, v: Column, azimuth: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of a place in a plan's frame."""
    north, east = local_scale(F.lit(lat0))
    e, n = unrotated(u, v, azimuth)
    return F.lit(lat0) + n / north, F.lit(lon0) + e / east


def line_name(line: Column) -> Column:
    return F.format_string("L%02d", line.cast("long") + 1)


def steering_points(runs: DataFrame) -> DataFrame:
    """azimuth, run, line, seq, name, desc, u, v: where each run starts (S), recording goes on (A) and off (E), and, if that is more than 20 m on, where the helm turns away (T)."""
    name, said = line_name(F.col("line")), F.concat(F.lit("line "), (F.col("line") + 1).cast("long").cast("string"))
    parted = F.abs(F.col("ends") - F.col("off")) > APART_M
    mark = lambda k, letter, desc, v: F.struct(F.lit(k).alias("seq"), F.concat(name, F.lit(letter)).alias("name"), F.concat(said, desc).alias("desc"), F.col(v).alias("v"))
    heading = F.format_string("%03d", F.rint("heading").cast("int"))
    start, on = mark(0, "S", F.concat(F.lit(" start of run-in, steer "), heading, F.lit("°T")), "starts"), mark(1, "A", F.lit(" recording on"), "on")
    marks = F.when(parted, F.array(start, on, mark(2, "E", F.lit(" recording off"), "off"), mark(3, "T", F.lit(" turn away"), "ends"))).otherwise(F.array(start, on, mark(2, "E", F.lit(" recording off, turn away"), "ends")))
    return runs.select("azimuth", "run", "line", "u", F.explode(marks).alias("m")).select("azimuth", "run", "line", "m.seq", "m.name", "m.desc", "u", "m.v")


def thinned(points: list, tolerance: float = TOLERANCE_M) -> list:
    """The points without which some place would lie farther than ``tolerance`` from the line through the two kept about it."""
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        long, far, at = math.hypot(x1 - x0, y1 - y0), 0.0, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = math.hypot(x - x0, y - y0) if long < 1e-9 else abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / long
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            spans += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def thin_turns(turns: DataFrame, tolerance: float = TOLERANCE_M) -> DataFrame:
    """``turns`` (azimuth, run, points (along, across)) with fewer points, as good as the tolerance."""

    def run(batches):
        for part in batches:
            yield part.assign(points=[[list(p) for p in thinned([tuple(p) for p in way], tolerance)] for way in part["points"]])

    return turns.select("azimuth", "run", "points").mapInPandas(run, "azimuth double, run int, points array<array<double>>")


def path_points(runs: DataFrame, turns: DataFrame) -> DataFrame:
    """azimuth, seq, u, v of the ship's whole way: each run's start and end and, between runs, the thinned turn; places that repeat the one before are left out."""
    ends = F.array(F.struct(F.lit(0).alias("k"), F.col("starts").alias("v"), F.col("u")), F.struct(F.lit(1).alias("k"), F.col("ends").alias("v"), F.col("u")))
    legs = runs.select("azimuth", "run", F.explode(ends).alias("p")).select("azimuth", "run", "p.k", "p.v", "p.u")
    inner = thin_turns(turns).select("azimuth", "run", F.posexplode(F.slice("points", 2, F.greatest(F.size("points") - 2, F.lit(0)))).alias("i", "p"))
    bent = inner.select("azimuth", "run", (F.col("i") + 2).alias("k"), F.get("p", F.lit(0)).alias("v"), F.get("p", F.lit(1)).alias("u"))
    whole = legs.unionByName(bent).groupBy("azimuth").agg(F.array_sort(F.collect_list(F.struct("run", "k", "v", "u"))).alias("way"))  # a plan's way: some thousand points
    same = lambda a, b: (F.abs(a["v"] - b["v"]) < 1e-4) & (F.abs(a["u"] - b["u"]) < 1e-4)
    fresh = F.filter("way", lambda p, i: (i == 0) | ~same(p, F.get("way", F.greatest(i - 1, F.lit(0)))))
    return whole.select("azimuth", F.posexplode(fresh).alias("seq", "p")).select("azimuth", "seq", "p.u", "p.v")


def plan_name(azimuth: Column) -> Column:
    return F.format_string("SEARCH %03dT", F.rint(azimuth).cast("int"))


def gpx_points(runs: DataFrame, turns: DataFrame, targets: DataFrame, lat0: float, lon0: float, rows_of: tuple[str, ...] = ("targets", "track"), route_per_line: bool = False, turn_points: bool = False) -> DataFrame:
    """path, kind, line, line_name, seq, lat, lon, name, desc of the documents of the plans, one for each azimuth.

    ``rows_of`` chooses among targets (target, name, lat, lon, radius, as waypoints of every plan), marks (the steering points as waypoints), routes (from the start to the end of each run, one for each line or one for all, with the
    middle of each turn if asked), and the track of the whole way.
    """
    path = plan_name(F.col("azimuth")).alias("path")
    marks, parts = steering_points(runs), []

    def row(frame: DataFrame, kind: str, line: Column, name: Column, seq: Column, called: Column, desc: Column) -> DataFrame:
        lat, lon = placed(F.col("u"), F.col("v"), F.col("azimuth"), lat0, lon0)
        return frame.select(path, F.lit(kind).alias("kind"), line.cast("int").alias("line"), name.alias("line_name"), seq.cast("long").alias("seq"), lat.alias("lat"), lon.alias("lon"), called.alias("name"), desc.alias("desc"))

    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    if "targets" in rows_of:
        said = F.format_string("target, uncertainty %.0f m", F.col("radius").cast("double"))
        places = targets.select(F.col("target").alias("seq"), "lat", "lon", "name", said.alias("desc"))
        parts.append(runs.select("azimuth").distinct().join(F.broadcast(places)).select(path, F.lit("waypoint").alias("kind"), nothing.alias("line"), none.alias("line_name"), F.col("seq").cast("long").alias("seq"), "lat", "lon", "name", "desc"))
    if "marks" in rows_of:
        parts.append(row(marks, "waypoint", nothing, none, F.lit(1 << 40) + F.col("run") * 4 + F.col("seq"), F.col("name"), F.col("desc")))
    first_track = F.lit(0)
    if "routes" in rows_of:
        legs = marks.where((F.col("seq") == 0) | F.col("name").endswith("T") | F.col("desc").endswith("turn away"))
        if route_per_line:
            parts.append(row(legs, "route", F.col("run") - 1, line_name(F.col("line")), F.col("seq"), F.col("name"), F.col("desc")))
            first_track = None
        else:
            way = legs.select("azimuth", "u", "v", (F.col("run") * 8 + F.col("seq")).alias("seq"), "name", "desc")
            if turn_points:
                middle = F.get("points", F.floor(F.size("points") / 2).cast("int"))
                way = way.unionByName(turns.select("azimuth", middle[1].alias("u"), middle[0].alias("v"), (F.col("run") * 8 + 7).alias("seq"), F.format_string("T%02d", F.col("run")).alias("name"), F.lit("turn apex").alias("desc")))
            parts.append(row(way, "route", F.lit(0), plan_name(F.col("azimuth")), F.col("seq"), F.col("name"), F.col("desc")))
            first_track = F.lit(1)
    if "track" in rows_of:
        whole = path_points(runs, turns)
        if first_track is None:
            whole = whole.join(F.broadcast(runs.groupBy("azimuth").agg(F.count("*").alias("n"))), "azimuth")
            first_track = F.col("n")
        parts.append(row(whole, "track", first_track, F.concat(plan_name(F.col("azimuth")), F.lit(" path")), F.col("seq"), none, none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gpx_documents(runs: DataFrame, turns: DataFrame, targets: DataFrame, lat0: float, lon0: float, rig: Rig = Rig(), **options) -> DataFrame:
    """path, gpx: the document of each azimuth, with a description of what its points steer."""
    said = (
        f"Waypoints steer the GPS antenna; the fish is {rig.offset_m:.0f} m astern. Each line is stretched by that offset so the fish, not the boat, crosses the box, and by {rig.run_in_m:.0f} m of run-in before the near edge"
        f" and {rig.run_out_m:.0f} m of run-out past the far one on top of it. Recording starts at the A point of each line and stops at the E point. No data is claimed in a turn."
    )
    name = plan_name(F.col("azimuth"))
    about = runs.select("azimuth").distinct().select(name.alias("path"), name.alias("name"), F.lit(said).alias("desc"))
    return gpx.documents(gpx_points(runs, turns, targets, lat0, lon0, **options), about)


def plan_shapes(boxes: DataFrame, lines: DataFrame, runs: DataFrame, turns: DataFrame, sonar: Sonar, rig: Rig = Rig()) -> DataFrame:
    """azimuth, kind, part, name, heading, teardrop, points (v, u) of what a chart shows of each plan.

    Kinds: box; cover (the bands that each line sees, cut to the box); gap (strips that none does); runin, line, short (the far end, which the fish does not reach before the turn) and runout of each run, cut at the edges of the
    box; turn. Polygons end where they begin. ``part`` numbers the shapes of a kind.
    """
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    at = lambda v, u: F.struct(v.cast("double").alias("v"), u.cast("double").alias("u"))
    ring = lambda u0, u1: F.array(at(F.col("v0"), u0), at(F.col("v0"), u1), at(F.col("v1"), u1), at(F.col("v1"), u0), at(F.col("v0"), u0))
    polygon = lambda frame, kind, part, u0, u1: frame.select("azimuth", F.lit(kind).alias("kind"), part.cast("long").alias("part"), none.alias("name"), number.alias("heading"), F.lit(None).cast("boolean").alias("teardrop"), ring(u0, u1).alias("points"))

    out = polygon(boxes, "box", F.lit(0), F.col("u0"), F.col("u1"))
    u = F.col("u")
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b")) for k, a, b in ((0, u + sonar.nadir_m, u + sonar.range_m), (1, u - sonar.range_m, u - sonar.nadir_m)))))
    bands = lines.select("azimuth", "line", "u").join(boxes.select("azimuth", "u0", "u1", "v0", "v1"), "azimuth").withColumn("s", sides)
    bands = bands.withColumns({"a": F.greatest("s.a", "u0"), "b": F.least("s.b", "u1")}).where(F.col("b") - F.col("a") >= 0.01)
    out = out.unionByName(polygon(bands, "cover", F.col("line") * 2 + F.col("s.k"), F.col("a"), F.col("b")))
    unseen = coverage(boxes, lines, sonar).where("worst = 0").select("azimuth")
    open_ = gaps(boxes, lines, sonar).join(unseen, "azimuth", "left_semi").join(boxes.select("azimuth", "v0", "v1"), "azimuth").where(F.col("u_to") - F.col("u_from") >= 0.01)
    out = out.unionByName(polygon(open_, "gap", F.floor(F.col("u_from") * 1000), F.col("u_from"), F.col("u_to")))

    way = F.col("dir")
    enter, leave = F.col("starts") + way * max(rig.run_in_m, 0.0), F.col("ends") - way * max(rig.run_out_m, 0.0)
    covered = leave - way * fish_short(rig)
    ahead = lambda a, b: (b - a) * way > 0.5
    short = F.when(ahead(enter, covered), covered).otherwise(enter)
    legs = F.array(*(F.when(ahead(a, b), F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))) for kind, a, b in (("runin", F.col("starts"), enter), ("line", enter, covered), ("short", short, leave), ("runout", leave, F.col("ends")))))
    cut = runs.select("azimuth", "line", "u", "heading", F.explode(F.filter(legs, lambda x: x.isNotNull())).alias("l"))
    heading = F.when(F.col("l.kind") == "line", F.col("heading").cast("double"))
    strips = cut.select("azimuth", F.col("l.kind").alias("kind"), F.col("line").cast("long").alias("part"), line_name(F.col("line")).alias("name"), heading.alias("heading"), F.lit(None).cast("boolean").alias("teardrop"), F.array(at(F.col("l.a"), u), at(F.col("l.b"), u)).alias("points"))
    bent = turns.select("azimuth", F.lit("turn").alias("kind"), F.col("run").cast("long").alias("part"), none.alias("name"), number.alias("heading"), "teardrop", F.transform("points", lambda p: at(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("points"))
    return out.unionByName(strips).unionByName(bent)


def plan_features(shapes: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """azimuth, kind, part, geojson: each shape as a feature, in degrees about a reference place."""

    def degrees(p: Column) -> Column:
        lat, lon = placed(p["u"], p["v"], F.col("azimuth"), lat0, lon0)
        return F.array(F.round(lon, 7), F.round(lat, 7))

    at = F.transform("points", degrees)
    properties = F.struct("kind", "name", "heading", "teardrop")  # nulls are left out
    feature = lambda shape, coordinates: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(shape).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))
    text = F.when(F.col("kind").isin("box", "cover", "gap"), feature("Polygon", F.array(at))).otherwise(feature("LineString", at))
    return shapes.select("azimuth", "kind", "part", text.alias("geojson"))
