"""Navigation: fixes, course and speed, interpolation, the towed body, survey lines.

Window functions do what a frame can say; the folds whose state is what they last kept run per recording in Arrow batches.
A recording is the unit of order and of parallel work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.functions.geodesy import distance_m, local_scale, wrap180
from seabright.operators.quantiles import quantiles


def fix_track(pings: DataFrame, min_gap: float = 0.05) -> DataFrame:
    """Rows whose position differs from the last kept one, at least ``min_gap`` seconds after it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time", "rec_id"], kind="stable")
        keep, last = np.zeros(len(rows), bool), None
        for i, now in enumerate(zip(rows["time"], rows["lat"], rows["lon"], strict=True)):
            if last is None or (now[1:] != last[1:] and now[0] - last[0] >= min_gap):
                keep[i], last = True, now
        return rows[keep]

    rows = pings.select("dataset", "rec_id", "time", "lat", "lon")
    return rows.groupBy("dataset").applyInPandas(fold, rows.schema)


def _ordered(*by: str):
    return Window.partitionBy(*by).orderBy("time", "seq")


def unwrapped(angle: Column, order) -> Column:
    """Angles without jumps: the first, plus the sum of wrapped steps."""
    step = wrap180(angle - F.lag(angle).over(order))
    return F.first(angle).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.sum(F.coalesce(step, F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))


def smoothed(value: Column, order, n: int) -> Column:
    """Mean of an odd number of rows, fewer at the ends."""
    half = (n | 1) // 2
    return F.avg(value).over(order.rowsBetween(-half, half))


def near_rows(function: str, column: str, key: str) -> Column:
    """An aggregate over the rows of a recording whose ``key`` differs by at most one: with a row number over (h + 0.5) as the key, h rows each way, fewer at the ends, and h may differ between recordings."""
    return F.expr(f"{function}({column}) over (partition by dataset order by {key} range between 1.0D preceding and 1.0D following)")


#: Fixes that a task sorts, about.
FIXES_A_TASK = 100_000


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by recording over tasks whose number follows the rows: the windows that come after sort them many times in one stage, in more memory than the narrow shuffled rows tell."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIXES_A_TASK))
    return rows.repartition(tasks, "dataset")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(_ordered("dataset")) - 1)


def track(fixes: DataFrame, baseline_s: float = 12.0) -> DataFrame:
    """dataset, seq, time, lat, lon with course (unwrapped), distance run and speed.

    Course and speed are between the fixes ``baseline_s`` seconds before and after, in whole fixes at the recording's middle interval and two at least, the ends held.
    Metres are on the plane about the recording's mean latitude, from its first fix: whole coordinates of millions of metres would leave noise in differences of a few.
    """
    order, whole = _ordered("dataset"), Window.partitionBy("dataset")
    rows = _numbered(_dealt(fixes)).withColumn("gap", F.col("time") - F.lag("time").over(order))
    middle = rows.groupBy("dataset").agg(F.expr("percentile_disc(0.5) within group (order by gap desc)").alias("gap"))
    reach = middle.select("dataset", F.greatest(F.round(baseline_s / F.greatest(F.coalesce("gap", F.lit(1.0)), F.lit(1e-3))), F.lit(2.0)).alias("reach"))
    north, east = local_scale(F.avg("lat").over(whole))
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    x, y = (F.col("lon") - first("lon")) * east, (F.col("lat") - first("lat")) * north
    rows = rows.drop("gap").join(reach, "dataset").withColumns({"x": x, "y": y, "k": F.col("n") / (F.col("reach") + 0.5)})
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0)))
    rows = rows.withColumn("dist", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({f"{c}{i}": near_rows(f, c, "k") for c in ("time", "x", "y", "dist") for i, f in ((0, "first"), (1, "last"))})
    rows = rows.withColumn("course", F.pmod(F.degrees(F.atan2(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(360.0)))
    rows = rows.withColumn("cog", unwrapped(F.col("course"), order))
    took = F.col("time1") - F.col("time0")
    return rows.select("dataset", "seq", "time", "lat", "lon", "cog", "dist", F.when(took > 1e-6, (F.col("dist1") - F.col("dist0")) / took).otherwise(0.0).alias("sog"))


def interpolate(series: DataFrame, probes: DataFrame, key: str, values: list[str], *by: str) -> DataFrame:
    """``probes`` with the linear interpolation of ``values`` at ``key``, the ends held.

    One sort per group: the series and the probes are merged in order of the key, and each probe sees the rows about it.
    """
    names = [*by, key]
    left = series.select(*names, *values, F.lit(True).alias("known"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in probes.schema) + ">").alias("row"))
    right = probes.select(*names, *(F.lit(None).cast("double").alias(v) for v in values), F.lit(False).alias("known"), F.struct(*probes.columns).alias("row"))
    here = F.when(F.col("known"), F.struct(F.col(key).alias("x"), *values))
    order = Window.partitionBy(*by).orderBy(key, F.desc("known"))
    before = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    backward = Window.partitionBy(*by).orderBy(F.desc(key), "known")  # the same order from its end: a frame that only grows is read in one pass
    after = F.last(here, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0))
    rows = left.unionByName(right).withColumns({"a": before, "b": after}).where("not known")
    x0, x1 = F.coalesce("a.x", "b.x"), F.coalesce("b.x", "a.x")
    share = F.when(x1 - x0 > 1e-12, (F.col(f"row.{key}") - x0) / (x1 - x0)).otherwise(F.lit(0.0))
    mixed = [(F.coalesce(f"a.{v}", f"b.{v}") + (F.coalesce(f"b.{v}", f"a.{v}") - F.coalesce(f"a.{v}", f"b.{v}")) * share).alias(f"{v}_at") for v in values]
    return rows.select("row.*", *mixed)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by recording over a told number of tasks, each recording's together and in order."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "dataset").sortWithinPartitions("dataset", "seq")


def pursuit(fixes: DataFrame, length: float, max_step: float = 0.1) -> DataFrame:
    """The towed body's position behind each fix: the tractrix of a taut tow of ``length`` metres, astern at first.

    ``fixes``: dataset, seq, x, y in metres, and optionally heading, the first course in degrees from north (else the first movement's). Between fixes the tow point moves in
    steps of at most ``max_step``. The curve is a recursion over a recording: a task follows its recordings one after the other, as rows come, and holds no more of one than the fixes before it first moves.
    """
    given = "heading" in fixes.columns

    def follow(batches):
        key, held, first, last, fish, out = object(), [], None, None, None, []

        def begin(heading: float) -> None:
            nonlocal fish
            fish = first[0] - length * np.sin(heading), first[1] - length * np.cos(heading)
            for k, seq in enumerate(held):
                step(seq, *first, 0.0) if k else out.append((key, seq, *fish))
            held.clear()

        def step(seq, x: float, y: float, far: float) -> None:
            nonlocal fish
            n = 4096 if far > 4096 * max_step else max(math.ceil(far / max_step), 1)
            (fx, fy), (x0, y0), dx, dy = fish, last, (x - last[0]) / n, (y - last[1]) / n
            for k in range(1, n + 1):
                px, py = (k * dx + x0, k * dy + y0) if k < n else (x, y)
                ux, uy = px - fx, py - fy
                d = (ux * ux + uy * uy) ** 0.5
                if d > 1e-9:  # the tow is always taut
                    fx, fy = px - length * ux / d, py - length * uy / d
            fish = fx, fy
            out.append((key, seq, fx, fy))

        def made(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (schema.field("dataset").type, pa.int64(), pa.float64(), pa.float64()), strict=True)], ["dataset", "seq", "fish_x", "fish_y"])

        for batch in batches:
            of, seqs = batch.column("dataset").to_pylist(), batch.column("seq").to_pylist()
            xs, ys = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            headings = batch.column("heading").to_pylist() if given else of
            fars = np.hypot(np.diff(xs, prepend=np.nan if last is None else last[0]), np.diff(ys, prepend=np.nan if last is None else last[1]))
            for dataset, seq, x, y, heading, far in zip(of, seqs, xs.tolist(), ys.tolist(), headings, fars.tolist(), strict=True):
                if dataset != key:
                    if held:
                        begin(0.0)
                    key, first, last, fish = dataset, (x, y), (x, y), None
                    held.append(seq)
                    if given:
                        begin(math.radians(heading))
                elif fish is not None:
                    step(seq, x, y, far)
                elif np.hypot(x - first[0], y - first[1]) > 0:
                    begin(np.arctan2(x - first[0], y - first[1]))
                    step(seq, x, y, far)
                else:
                    held.append(seq)
                last = x, y
            yield made(batch.schema)
        if held:
            begin(0.0)
            yield made(batch.schema)

    kind = fixes.schema["dataset"].dataType.simpleString()
    columns = ["dataset", F.col("seq").cast("long").alias("seq"), "x", "y", *(["heading"] if given else [])]
    return in_order(fixes.select(*columns)).mapInArrow(follow, f"dataset {kind}, seq long, fish_x double, fish_y double")


def detect_lines(track: DataFrame, rate: float = 0.9, min_seconds: float = 180.0, smooth_seconds: float = 20.0) -> DataFrame:
    """Segments (dataset, kind, begins, ends, course, length_m) of steady course and of turning; recordings of three fixes or more.

    ``track``: dataset, seq, time, cog (unwrapped), dist. Steady runs shorter than ``min_seconds`` count as turning, and turns that meet merge; a merged turn keeps the
    first one's course, a segment's course is the mean of those at its ends.
    """
    order = _ordered("dataset")
    rows = _numbered(track)
    shape = rows.groupBy("dataset").agg(F.count("*").alias("count"), ((F.max("time") - F.min("time")) / (F.count("*") - 1)).alias("dt")).where("count >= 3")
    width = F.greatest(F.round(smooth_seconds / F.greatest("dt", F.lit(1e-3))), F.lit(1.0))
    shape = shape.select("dataset", F.floor(width / 2).alias("half"))  # an odd width
    rows = rows.join(shape, "dataset").withColumn("k", F.col("n") / (F.col("half") + 0.5))
    rows = rows.withColumn("s", near_rows("avg", "cog", "k"))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.col(c))
    after = lambda c: F.coalesce(F.lead(c).over(order), F.col(c))
    rows = rows.withColumn("turn", F.abs(after("s") - before("s")) / F.greatest(after("time") - before("time"), F.lit(1e-6)))
    rows = rows.withColumn("steady", near_rows("avg", "turn", "k") < rate)
    change = F.coalesce((F.col("steady") != F.lag("steady").over(order)).cast("int"), F.lit(1))
    runs = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("time", "seq")
    spans = runs.groupBy("dataset", "run").agg(
        F.first("steady").alias("steady"), F.min("time").alias("begins"), F.max("time").alias("ends"), F.min_by("s", at).alias("s0"), F.max_by("s", at).alias("s1"),
        (F.max("dist") - F.min("dist")).alias("length_m"),
    )
    spans = spans.withColumns({
        "course": F.pmod((F.col("s0") + F.col("s1")) / 2, F.lit(360.0)),
        "kind": F.when(F.col("steady") & (F.col("ends") - F.col("begins") >= min_seconds), "line").otherwise("turn"),
    })
    by_run = Window.partitionBy("dataset").orderBy("run")
    fresh = F.when((F.col("kind") == "turn") & (F.lag("kind").over(by_run) == "turn"), 0).otherwise(1)
    merged = spans.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(by_run.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("dataset", "segment").agg(
        F.first("kind").alias("kind"), F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.min_by("course", "run").alias("course"), F.sum("length_m").alias("length_m")
    ).drop("segment")


def turn_rate_at(track: DataFrame, probes: DataFrame, reach: float = 3.0) -> DataFrame:
    """``probes`` (dataset, probe, time) with rate: degrees a second of the course between ``reach`` seconds before and after, the ends held."""
    both = probes.select("dataset", "probe", F.explode(F.array(F.lit(-reach), F.lit(reach))).alias("d"), F.col("time").alias("at")).withColumn("time", F.col("at") + F.col("d"))
    found = interpolate(track.select("dataset", "time", "cog"), both, "time", ["cog"], "dataset")
    return found.groupBy("dataset", "probe", F.col("at").alias("time")).agg((F.sum(F.signum("d") * F.col("cog_at")) / (2 * reach)).alias("rate"))


def astern(track: DataFrame, metres: float) -> DataFrame:
    """Fixes with the place ``metres`` behind along the course."""
    from seabright.functions.geodesy import offset_m

    lat, lon = offset_m(F.col("lat"), F.col("lon"), F.col("cog") + 180, F.lit(metres))
    return track.withColumns({"fish_lat": lat, "fish_lon": lon})


def trailing(track: DataFrame, metres: float) -> DataFrame:
    """Fixes with the place on the track ``metres`` of run behind, the start before that."""
    back = track.select("dataset", "seq", (F.col("dist") - metres).alias("dist"))
    steps = track.groupBy("dataset", "dist").agg(F.max_by("lat", "seq").alias("lat"), F.max_by("lon", "seq").alias("lon"))  # one row where the ship lay still
    there = interpolate(steps, back, "dist", ["lat", "lon"], "dataset").select("dataset", "seq", F.col("lat_at").alias("fish_lat"), F.col("lon_at").alias("fish_lon"))
    return track.join(there, ["dataset", "seq"])


def tractrix(track: DataFrame, layback: float, towpoint: float) -> DataFrame:
    """Fixes with the place of a fish that a taut tow of ``layback`` metres pulls behind the tow point, ``towpoint`` metres astern of the antenna."""
    mid = track.groupBy("dataset").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.min_by("cog", "seq").alias("heading"))
    north, east = local_scale(F.col("lat0"))
    back = F.radians(F.col("cog") + 180)
    rows = track.join(mid, "dataset").withColumns({"x": (F.col("lon") - F.col("lon0")) * east + towpoint * F.sin(back), "y": (F.col("lat") - F.col("lat0")) * north + towpoint * F.cos(back)})
    found = pursuit(rows.select("dataset", F.col("seq").cast("long").alias("seq"), "x", "y", "heading"), layback).join(mid.drop("heading"), "dataset")
    there = found.select("dataset", "seq", (F.col("lat0") + F.col("fish_y") / north).alias("fish_lat"), (F.col("lon0") + F.col("fish_x") / east).alias("fish_lon"))
    return track.join(there, ["dataset", "seq"])


def model_spread(track: DataFrame, layback: float, step: int = 101, towpoint: float = 0.0) -> DataFrame:
    """dataset, middle, most: the greatest distance between the three models (astern, wake and tractrix) at every ``step``th fix, the upper median and the 95th percentile of a recording."""
    models = [astern(track, layback + towpoint), trailing(track, layback + towpoint), tractrix(track, layback, towpoint)]
    rows = None
    for k, model in enumerate(models):
        one = model.where(F.col("seq") % step == 0).select("dataset", "seq", F.col("fish_lat").alias(f"lat{k}"), F.col("fish_lon").alias(f"lon{k}"))
        rows = one if rows is None else rows.join(one, ["dataset", "seq"])
    pairs = [distance_m(F.col(f"lat{a}"), F.col(f"lon{a}"), F.col(f"lat{b}"), F.col(f"lon{b}")) for a, b in ((0, 1), (0, 2), (1, 2))]
    apart = rows.select("dataset", F.greatest(*pairs).alias("apart"))
    middle = quantiles(apart, "apart", {"middle": 0.5, "most": 0.95}, "dataset", rule="upper")
    return middle.select("dataset", "middle", "most")


def advance(rows: DataFrame) -> DataFrame:
    """Rows with the distance from the row before, zero for a recording's first."""
    order = Window.partitionBy("dataset").orderBy("row")
    step = distance_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return rows.withColumn("advance_m", F.coalesce(step, F.lit(0.0)))


def compass(headings: DataFrame, seconds: float = 2.0) -> DataFrame:
    """dataset, time, heading: unwrapped and averaged over as many rows as come in ``seconds`` at the recording's mean interval (an odd number, fewer at the ends); the first of equal times counts."""
    first = headings.groupBy("dataset", "time").agg(F.min_by("heading", "rec_id").alias("heading"))
    order = Window.partitionBy("dataset").orderBy("time")
    spans = first.groupBy("dataset").agg(F.count("*").alias("many"), ((F.max("time") - F.min("time")) / (F.count("*") - 1)).alias("gap"))
    wide = F.when(F.col("many") > 2, F.greatest(F.round(seconds / F.greatest("gap", F.lit(1e-3))), F.lit(1.0))).otherwise(F.lit(1.0))
    half = spans.select("dataset", F.floor(wide / 2).alias("half"))  # an even number of rows takes one more
    rows = first.withColumn("heading", unwrapped(F.col("heading"), order)).withColumn("n", F.row_number().over(order) - 1).join(half, "dataset")
    return rows.withColumn("k", F.col("n") / (F.col("half") + 0.5)).select("dataset", "time", near_rows("avg", "heading", "k").alias("heading"))
