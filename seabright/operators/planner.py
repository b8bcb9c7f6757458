"""Search plans: parallel lines over uncertain targets, their coverage, and the choice of azimuth."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.functions.geodesy import local_scale
from seabright.operators import turns


@dataclass(frozen=True)
class Sonar:
    range_m: float = 75.0
    altitude_m: float = 8.0
    nadir_factor: float = 1.0
    mode: str = "double"  # recon, full, double or custom
    spacing_m: float = 65.0

    @property
    def nadir_m(self) -> float:
        return min(max(self.nadir_factor * self.altitude_m, 0.0), 0.6 * self.range_m)

    @property
    def spacing(self) -> float:
        wanted = {"recon": 2 * (self.range_m - self.nadir_m), "full": self.range_m, "double": self.range_m - self.nadir_m}
        return max(wanted.get(self.mode, self.spacing_m), 5.0)


    @property
    def twice(self) -> bool:
        """Whether two looks are promised everywhere: then a line runs beyond each side of the box."""
        return self.mode == "double" or self.mode == "custom" and self.spacing <= self.range_m - self.nadir_m


@dataclass(frozen=True)
class Rig:
    run_in_m: float = 150.0
    run_out_m: float = 60.0
    knots: float = 3.5
    turn_radius_m: float = 40.0
    turn_seconds: float = 90.0
    layback_m: float = 44.0
    gps_to_towpoint_m: float = 10.0

    @property
    def offset_m(self) -> float:
        return self.layback_m + self.gps_to_towpoint_m


def rotated(targets: DataFrame, azimuths: DataFrame) -> DataFrame:
    """Targets (target, x, y, radius) in each frame (azimuth): u across the lines, v along them. Azimuths are at most 91."""
    a = F.radians("azimuth")
    return targets.join(F.broadcast(azimuths)).withColumns({"u": F.col("x") * F.cos(a) - F.col("y") * F.sin(a), "v": F.col("x") * F.sin(a) + F.col("y") * F.cos(a)})


def plan_boxes(targets: DataFrame, azimuths: DataFrame, sonar: Sonar, margin: float = 80.0) -> DataFrame:
    """Per azimuth: the box of the uncertainty circles, number of lines, their spacing, and the place of the first."""
    r, margin = F.greatest("radius", F.lit(0.0)), max(margin, 0.0)
    box = rotated(targets, azimuths).groupBy("azimuth").agg(
        (F.min(F.col("u") - r) - margin).alias("u0"), (F.max(F.col("u") + r) + margin).alias("u1"),
        (F.min(F.col("v") - r) - margin).alias("v0"), (F.max(F.col("v") + r) + margin).alias("v1"),
    )
    width = F.col("u1") - F.col("u0")
    span, pad = F.greatest(width, F.lit(sonar.spacing)), 1 if sonar.twice else 0
    box = box.withColumn("inner", F.greatest(F.ceil(width / sonar.spacing) + 1, F.lit(2))).withColumn("gap", span / (F.col("inner") - 1))
    first = (F.col("u0") + F.col("u1")) / 2 - span / 2 - pad * F.col("gap")
    return box.withColumns({"lines": F.col("inner") + 2 * pad, "first": first}).drop("inner")


def plan_lines(boxes: DataFrame, rig: Rig = Rig(), spread: bool = True) -> DataFrame:
    """azimuth, line, u, v0, v1 in order of running: every skip-th line, so that turns are wide enough, or (not ``spread``) one after another."""
    rows = boxes.select("azimuth", "gap", "first", "v0", "v1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lines") - 1)).alias("line"))
    skip = F.greatest(F.ceil(2 * rig.turn_radius_m / F.col("gap")), F.lit(1)) if spread else F.lit(1)
    order = Window.partitionBy("azimuth").orderBy(F.col("line") % F.col("skip"), "line")
    return rows.withColumns({"u": F.col("first") + F.col("line") * F.col("gap"), "skip": skip}).withColumn("run", F.row_number().over(order)).select("azimuth", "line", "run", "u", "v0", "v1")


def plan_runs(lines: DataFrame, rig: Rig = Rig(), one_way: bool = False) -> DataFrame:
    """Lines as runs: direction, where along it the ship starts, the fish comes on and goes off, the ship ends; heading and length."""
    way = F.when(F.lit(one_way) | (F.col("run") % 2 == 1), 1.0).otherwise(-1.0)
    rows = lines.withColumn("dir", way)
    start, end = F.when(F.col("dir") > 0, F.col("v0")).otherwise(F.col("v1")), F.when(F.col("dir") > 0, F.col("v1")).otherwise(F.col("v0"))
    run_in, run_out = max(rig.run_in_m, 0.0), max(rig.run_out_m, 0.0)
    return rows.select(
        "azimuth", "line", "run", "u", "dir",
        (start - F.col("dir") * run_in).alias("starts"), (start + F.col("dir") * rig.offset_m).alias("on"),
        (end + F.col("dir") * min(rig.offset_m, run_out)).alias("off"), (end + F.col("dir") * run_out).alias("ends"),
        F.when(F.col("dir") > 0, F.col("azimuth")).otherwise(F.pmod(F.col("azimuth") + 180, F.lit(360.0))).alias("heading"),
        (F.col("v1") - F.col("v0") + run_in + run_out).alias("length"),
    )


def fish_short(rig: Rig = Rig()) -> float:
    """Metres of the box that the towed fish leaves out at the far edge."""
    return max(rig.offset_m - max(rig.run_out_m, 0.0), 0.0)


def plan_turns(runs: DataFrame, rig: Rig = Rig()) -> DataFrame:
    """azimuth, run, points (along, across), length, teardrop: the way from the end of each run to the start of the next."""
    order = Window.partitionBy("azimuth").orderBy("run")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("starts", "u", "dir")}
    pairs = runs.withColumns(ahead).where("next_u is not null").select("azimuth", "run", "ends", "u", "dir", *ahead)
    radius = max(rig.turn_radius_m, 1.0)

    def way(batches):
        for part in batches:
            out = []
            for x in part.itertuples(index=False):
                end, begin = (x.ends, x.u), (x.next_starts, x.next_u)
                if x.dir != x.next_dir:
                    legs, straight = [(end, x.dir, begin, x.next_dir)], 0.0
                else:  # one way: out, back outside the box, and in again
                    aside = x.u + 2 * radius * (1 if x.next_u >= x.u else -1)
                    legs, straight = [(end, x.dir, (end[0], aside), -x.dir), ((begin[0], aside), -x.dir, begin, x.next_dir)], abs(end[0] - begin[0])
                points, length, teardrop = [], straight, False
                for a, way_a, b, way_b in legs:
                    start = (*a, 0.0 if way_a > 0 else math.pi)
                    word, lengths = turns.turn_path(start, (*b, 0.0 if way_b > 0 else math.pi), radius)
                    points += [list(p) for p in turns.turn_points(start, word, lengths, radius)]
                    length, teardrop = length + sum(lengths), teardrop or "S" not in word
                out.append((x.azimuth, x.run, points, length, teardrop))
            yield pd.DataFrame(out, columns=["azimuth", "run", "points", "length", "teardrop"])

    return pairs.mapInPandas(way, "azimuth double, run int, points array<array<double>>, length double, teardrop boolean")


def seen(distance: Column, sonar: Sonar) -> Column:
    return (F.abs(distance) >= sonar.nadir_m) & (F.abs(distance) <= sonar.range_m)


def coverage(boxes: DataFrame, lines: DataFrame, sonar: Sonar, samples: int = 1400) -> DataFrame:
    """Per azimuth: shares of the box seen by no line, one or more, and two or more; and the least looks anywhere. Samples reach both edges."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.col("u0") + i * ((F.col("u1") - F.col("u0")) / (samples - 1)))).alias("k", "at")
    points = boxes.select("azimuth", at)
    looks = points.join(lines.select("azimuth", "u"), "azimuth").groupBy("azimuth", "k").agg(F.count_if(seen(F.col("at") - F.col("u"), sonar)).alias("looks"))
    share = lambda c: F.avg(c.cast("double"))
    return looks.groupBy("azimuth").agg(share(F.col("looks") == 0).alias("none"), share(F.col("looks") >= 1).alias("once"), share(F.col("looks") >= 2).alias("twice"), F.min("looks").alias("worst"))


def target_looks(targets: DataFrame, azimuths: DataFrame, lines: DataFrame, sonar: Sonar, samples: int = 21) -> DataFrame:
    """Per azimuth and target: least looks and least good looks over places across its circle, whether both sides always see it, a verdict, and the nearest line.

    A good look is neither too steep (15 % of the range) nor too far (90 %).
    """
    r = F.greatest("radius", F.lit(0.0))
    spots = rotated(targets, azimuths).withColumn("spot", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    spots = spots.withColumn("at", F.col("u") - r + 2 * r * F.col("spot") / (samples - 1)).select("azimuth", "target", "spot", "at", F.col("u").alias("middle"))
    d = F.col("line_u") - F.col("at")
    good = seen(d, sonar) & F.abs(d).between(max(sonar.nadir_m, 0.15 * sonar.range_m), 0.90 * sonar.range_m)
    looks = spots.join(lines.select("azimuth", F.col("u").alias("line_u")), "azimuth").groupBy("azimuth", "target", "spot").agg(
        F.count_if(seen(d, sonar)).alias("looks"), F.count_if(good).alias("good"), F.count_if(seen(d, sonar) & (d > 0)).alias("positive"), F.min(F.abs(F.col("line_u") - F.col("middle"))).alias("nearest")
    )
    both = (F.col("positive") > 0) & (F.col("positive") < F.col("looks"))
    worst = looks.groupBy("azimuth", "target").agg(F.min("looks").alias("looks"), F.min("good").alias("good"), F.bool_and(both).alias("both"), F.min("nearest").alias("nearest"))
    verdict = F.when(F.col("looks") == 0, "missed").when((F.col("looks") >= 2) & F.col("both") & (F.col("good") >= 1), "good").otherwise("thin")
    return worst.withColumn("verdict", verdict)


def run_time(runs: DataFrame, turns_: DataFrame, rig: Rig = Rig()) -> DataFrame:
    """Per azimuth: metres of lines and of turns, seconds for all, and the number of teardrop turns."""
    lines = runs.groupBy("azimuth").agg(F.sum("length").alias("line_m"))
    turning = turns_.groupBy("azimuth").agg(F.sum("length").alias("turn_m"), F.count("*").alias("turns"), F.count_if("teardrop").alias("teardrops"))
    rows = lines.join(turning, "azimuth", "left").fillna(0)
    metres = F.col("line_m") + F.col("turn_m")
    speed = max(rig.knots, 0.1) * 1852 / 3600
    return rows.select("azimuth", "line_m", "turn_m", metres.alias("metres"), (metres / speed + F.col("turns") * rig.turn_seconds).alias("seconds"), "teardrops")


def azimuth_steps(spark, step: float = 10.0) -> DataFrame:
    step = min(max(step, 1.0), 45.0)
    return spark.range(int(90 // step) + 1).select((F.col("id") * step).alias("azimuth"))


def quadrant(targets: DataFrame, azimuths: DataFrame, sonar: Sonar = Sonar(), rig: Rig = Rig(), margin: float = 80.0, one_way: bool = False, spread: bool = False) -> DataFrame:
    """A summary of the plan of each azimuth: lines, metres, seconds, coverage, and the worst verdict of a target."""
    boxes = plan_boxes(targets, azimuths, sonar, margin)
    lines = plan_lines(boxes, rig, spread and not one_way)
    runs = plan_runs(lines, rig, one_way)
    rank = F.when(F.col("verdict") == "missed", 0).when(F.col("verdict") == "thin", 1).otherwise(2)
    worst = target_looks(targets, azimuths, lines, sonar).groupBy("azimuth").agg(F.min_by("verdict", rank).alias("verdict"))
    return boxes.select("azimuth", "lines", "gap").join(run_time(runs, plan_turns(runs, rig), rig), "azimuth").join(coverage(boxes, lines, sonar), "azimuth").join(worst, "azimuth")


def unrotated(u: Column, v: Column, azimuth: Column) -> tuple[Column, Column]:
    """East and north metres of a place in a plan's frame."""
    a = F.radians(azimuth)
    return u * F.cos(a) + v * F.sin(a), v * F.cos(a) - u * F.sin(a)


def gaps(boxes: DataFrame, lines: DataFrame, sonar: Sonar, samples: int = 500) -> DataFrame:
    """azimuth, u_from, u_to: strips of the box that no line sees, from the first of even samples to the first that is seen again, or to the edge."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.col("u0") + i * ((F.col("u1") - F.col("u0")) / (samples - 1)))).alias("k", "at")
    looks = boxes.select("azimuth", at).join(lines.select("azimuth", "u"), "azimuth").groupBy("azimuth", "k", "at").agg(F.count_if(seen(F.col("at") - F.col("u"), sonar)).alias("looks"))
    ends = boxes.select(F.col("azimuth").alias("of"), ((F.col("u1") - F.col("u0")) / (samples - 1)).alias("step"), "u1")
    islands = looks.where("looks = 0").withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("azimuth").orderBy("k")))
    return islands.groupBy("azimuth", "island").agg(F.min("at").alias("u_from"), F.max("at").alias("last")).join(F.broadcast(ends), F.col("azimuth") == F.col("of")).select("azimuth", "u_from", F.least(F.col("last") + F.col("step"), "u1").alias("u_to"))
