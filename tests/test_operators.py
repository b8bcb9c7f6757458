import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seabright.functions import arrays, kernels
from seabright.operators import contacts, mosaic, navigation, pings, planner, rows, waterfall


def test_percentile_and_filters(spark):
    v = np.array([1.0, 2, 3, 4, 5])
    assert [kernels.finite_percentile(v, p) for p in (0, 12.5, 25, 50, 100)] == [1, 1.5, 2, 3, 5] and kernels.finite_percentile([], 50) == 0
    assert kernels.smooth(np.array([3.0, 0, 0]), 3).tolist() == [2, 1, 0]
    assert kernels.median_filter(np.array([9.0, 1, 1, 5]), 3).tolist() == [9, 1, 1, 5]
    row = spark.createDataFrame([([3.0, 0.0, 0.0],)], "t array<double>").select(arrays.smooth_clamped(F.col("t"), 3).alias("s"), arrays.bin_columns(F.col("t"), 2).alias("b"), arrays.upper_median(F.col("t")).alias("m")).first()
    assert row.s == [2, 1, 0] and row.b == [1.5] and row.m == 0


def test_bottom():
    trace = np.full(200, 1.0)
    trace[60:] = 50
    assert abs(kernels.refine_bottom(trace, 55) - 60) <= 2 and kernels.refine_bottom(np.ones(200), 55) == 55
    assert kernels.steady_prior(np.array([0.0, 5, 0, 5, 90, 5]), 3).tolist() == [0, 5, 0, 5, 5, 5]


def test_fix_track_keeps_by_last_kept(spark):
    log = [(0.0, 1.0), (0.03, 2.0), (0.06, 2.0), (0.5, 1.0), (0.52, 3.0), (0.6, 3.0)]
    df = spark.createDataFrame([("d", i, t, p, 0.0) for i, (t, p) in enumerate(log)], "dataset string, rec_id long, time double, lat double, lon double")
    assert sorted(r.rec_id for r in navigation.fix_track(df).collect()) == [0, 2, 3, 5]


def test_interpolation_holds_its_ends(spark):
    series = spark.createDataFrame([("d", float(t), float(t * t)) for t in (1, 2, 4)], "dataset string, time double, y double")
    probes = spark.createDataFrame([("d", i, t) for i, t in enumerate((0.0, 1.0, 1.5, 3.0, 4.0, 9.0))], "dataset string, k int, time double")
    got = navigation.interpolate(series, probes, "time", ["y"], "dataset").orderBy("k").collect()
    assert [r.y_at for r in got] == [1, 1, 2.5, 10, 16, 16]


@pytest.mark.parametrize("radius", [150.0, 90.0])
def test_tow_cuts_the_corner(spark, radius):
    n = int(6 * 2 * math.pi * radius / 2.6)
    a = np.arange(n) * 2.6 / radius
    df = spark.createDataFrame([("d", i, float(x), float(y)) for i, (x, y) in enumerate(zip(radius * np.cos(a), radius * np.sin(a)))], "dataset string, seq long, x double, y double")
    last = navigation.pursuit(df, 48.0).orderBy(F.desc("seq")).first()
    assert abs(math.hypot(last.fish_x, last.fish_y) - math.sqrt(radius**2 - 48**2)) < 0.05


def test_lines_and_turns(spark):
    cog = [0.0] * 300 + [i * 3.0 for i in range(60)] + [180.0] * 300
    df = spark.createDataFrame([("d", i, float(i), c, 2.0 * i) for i, c in enumerate(cog)], "dataset string, seq long, time double, cog double, dist double")
    got = navigation.detect_lines(df, 0.9, 180.0, 20.0).orderBy("begins").collect()
    assert [r.kind for r in got] == ["line", "turn", "line"] and abs(got[2].course - 180) < 30
    assert all(r.length_m == 2 * (r.ends - r.begins) for r in got)
    assert navigation.detect_lines(df.limit(2)).count() == 0


def test_rows_pair_by_session(spark):
    log = [(0.00, 20, 0), (0.01, 20, 1), (0.02, 21, 0), (0.10, 20, 0), (0.11, 20, 0), (0.13, 20, 1), (0.40, 21, 1)]
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate(log)], "dataset string, rec_id long, time double, subsystem long, channel long")
    got = {(r.row, r.subsystem): (r.port_id, r.stbd_id, r.at_id) for r in rows.pair_bands(df, 0.05 / 0.75).collect()}
    assert got == {(0, 20): (0, 1, 0), (0, 21): (2, None, 0), (1, 20): (3, None, 3), (1, 21): (None, None, 3), (2, 20): (4, 5, 4), (2, 21): (None, None, 4), (3, 20): (None, None, 6), (3, 21): (None, 6, 6)}


def test_pixels_and_places(spark):
    line = spark.createDataFrame([(i, 52.5 + i * 1e-5, 4.0, 0.0, 8.0, 50.0) for i in range(10)], "row long, lat double, lon double, bearing double, altitude double, half_width_m double")
    lat, lon = rows.pixel_to_world(F.lit(600.0), 1024, F.col("lat"), F.col("lon"), F.col("bearing"), F.col("altitude"), F.col("half_width_m"))
    point = line.where("row = 4").select(F.lit(0).alias("point"), lat.alias("at_lat"), lon.alias("at_lon"))
    got = rows.world_to_pixel(line, point, 1024).first()
    assert abs(got.x - 600) < 0.01 and got.y == 4.5
    slant = line.select(rows.pixel_to_world(F.lit(515.0), 1024, F.col("lat"), F.col("lon"), F.col("bearing"), F.col("altitude"), F.col("half_width_m"), False)[0].alias("lat"))
    assert {r.lat for r in slant.collect()} == {None}


def test_cells_and_speckle(spark):
    cells = spark.createDataFrame([(0, 0, 2.0, 1.0), (0, 0, 4.0, 3.0), (1, 0, 5.0, 0.0), (1, 1, None, 1.0)], "gx long, gy long, amp double, pri double")
    assert [tuple(r) for r in mosaic.finish(mosaic.accumulate(cells)).collect()] == [(0, 0, 3.5, 1 + 1)]
    rng = np.random.default_rng(0)
    plane = 100 * (0.7 + 0.6 * rng.random((100, 100)))
    plane[50:52, 50:52] = 900
    df = spark.createDataFrame([(i, j, float(plane[i, j])) for i in range(100) for j in range(100) if not (10 <= i < 20 and 10 <= j < 20)], "gx long, gy long, value double")
    out = {(r.gx, r.gy): r.value for r in mosaic.despeckle(df).collect()}
    assert len(out) == 9900 and (15, 15) not in out
    calm = np.array([x for (i, j), x in out.items() if abs(i - 50) > 6 or abs(j - 50) > 6])
    assert calm.std() / calm.mean() < 0.5 * plane[60:].std() / plane[60:].mean() and abs(calm.mean() / 100 - 1) < 0.02 and max(out.values()) > 720


def test_tiles_and_lines_of_samples(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1), (1, 1, 3.0, 2), (4, 0, 7.0, 1)], "gx long, gy long, value double, cover int")
    assert sorted(tuple(r) for r in mosaic.tile(df, 1).collect()) == [(0, 0, 2.0, 2), (2, 0, 7.0, 1)]
    assert mosaic.magnify(df, 1).count() == 12
    stroke = spark.createDataFrame([(0, [(0.5, 0.5, 1.0, 1.0), (4.5, 0.5, 5.0, 1.0)])], "stroke long, samples array<struct<x:double,y:double,amp:double,pri:double>>")
    assert [(r.gx, r.amp) for r in mosaic.splat_line(stroke).orderBy("amp").collect()] == [(1, 1.5), (2, 2.5), (3, 3.5), (4, 4.5)]


def test_waterfall(spark):
    trace = [1.0] * 40 + [50.0 + i % 3 for i in range(160)]
    df = spark.createDataFrame([("d", i, trace, trace if i % 2 else None, 4.0, 0.1, 0.0, i * 0.5, 0.0) for i in range(40)], "dataset string, row long, port array<double>, stbd array<double>, altitude_m double, resolution_m double, x double, y double, bearing double")
    model = waterfall.gain_model(df, 64)
    assert model.first().pings == 40
    image = waterfall.render(df, model, 64).orderBy("row").collect()
    assert len(image) == 40 and all(len(r.pixels) == 64 for r in image) and max(image[0].pixels[32:]) == 0
    laid = waterfall.strokes(df, 64).first()
    xs = [s.x for s in laid.samples]
    assert xs == sorted(xs) and laid.port_level > 0
    assert waterfall.window_of(df, 10, 12, 5).count() == 3
    assert waterfall.gain_model(df, 64, max_range_m=5.0).first().half_width_m == 5.0


def test_priors_follow_the_kernel(spark):
    recorded = [None, 4.0, 4.2, None, 9.9, 4.1, 4.0, 4.3, None, 4.4, 4.2, 4.1, 4.0, 1.0]
    df = spark.createDataFrame([("d", i, None, None, a, 0.1) for i, a in enumerate(recorded)], "dataset string, row long, port array<double>, stbd array<double>, altitude_m double, resolution_m double")
    got = [r.prior for r in waterfall.with_priors(df).orderBy("row").collect()]
    assert np.allclose(got, kernels.steady_prior(np.array([0.0 if a is None else a / 0.1 for a in recorded]), 9))


def plain_mosaic(strokes):
    """Cells painted by loops over strokes: (usable, samples of across, x, y, amp, pri)."""
    cells, old = {}, None

    def splat(x, y, amp, pri):
        c = cells.setdefault((math.floor(x), math.floor(y)), [0.0, 0.0, 0])
        c[0], c[1], c[2] = c[0] + amp * pri, c[1] + pri, c[2] + 1

    def bridge(a, b, most):
        n = min(max(math.ceil(math.hypot(b[0] - a[0], b[1] - a[1])), 1), most)
        for k in range(n):
            splat(*(p + (q - p) * (k + 0.5) / n for p, q in zip(a, b)))

    for usable, samples in strokes:
        if not usable:
            old = None
            continue
        splat(*samples[0][1:])
        for a, b in zip(samples, samples[1:]):
            bridge(a[1:], b[1:], 64)
        for s in samples if old else ():
            right = next((k for k, o in enumerate(old) if o[0] >= s[0]), len(old))
            if 0 < right < len(old) and old[right][0] - old[right - 1][0] <= 1:
                share = (s[0] - old[right - 1][0]) / max(old[right][0] - old[right - 1][0], 1e-9)
                back = [p + (q - p) * share for p, q in zip(old[right - 1][1:], old[right][1:])]
                if math.hypot(s[1] - back[0], s[2] - back[1]) <= 12:
                    bridge(back, s[1:], 16)
        old = samples
    return {k: (a / w, min(n, 255)) for k, (a, w, n) in cells.items()}


def test_mosaic_is_the_plain_painting(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows_ = [("d", i, (rng.random(60) * 100 + 1).tolist(), (rng.random(60) * 100 + 1).tolist() if i != 4 else None, 2.0, 0.1, i * 3.0 if i != 9 else 90.0, i * 0.3, float(i * 4), i not in (6, 13)) for i in range(20)]
    df = spark.createDataFrame(rows_, "dataset string, row long, port array<double>, stbd array<double>, altitude_m double, resolution_m double, x double, y double, bearing double, usable boolean")
    laid = waterfall.strokes(df, 64).orderBy("stroke").collect()
    assert len(laid) == 20
    strokes = [(rows_[r.stroke][-1], [tuple(s) for s in r.samples]) for r in laid]
    got = {(r.gx, r.gy): (r.value, r.cover, r.grey) for r in mosaic.build(df, 64, agc=0.0).collect()}
    want = plain_mosaic(strokes)
    for chunk in (3, 1):
        monkeypatch.setattr(mosaic, "CHUNK", chunk)
        again = {(r.gx, r.gy): (r.value, r.cover, r.grey) for r in mosaic.build(df, 64, agc=0.0).collect()}
        assert again.keys() == got.keys() and all(again[k][1:] == v[1:] and abs(again[k][0] - v[0]) < 1e-9 * abs(v[0]) for k, v in got.items())
    assert got.keys() == want.keys() and all(abs(got[k][0] - v) < 1e-6 * abs(v) + 1e-9 and got[k][1] == n for k, (v, n) in want.items())
    assert min(g for _, _, g in got.values()) == 0 and max(g for _, _, g in got.values()) == 255
    curves = spark.createDataFrame([(-1, [2.0] * 90), (1, [4.0] * 90)], "side int, curve array<double>")
    halved = {r.stroke: r for r in waterfall.strokes(df, 64, angle=curves).collect()}
    assert all(abs(a.amp - b.amp * (2 if a.across < 0 else 4)) < 1e-9 for r in laid for a, b in zip(r.samples, halved[r.stroke].samples))
    assert mosaic.build(df, 64, speckle=1.0, db=True).count() == len(want)


def test_plan(spark):
    sonar = planner.Sonar()
    assert (sonar.nadir_m, sonar.spacing) == (8, 67)
    targets = spark.createDataFrame([(0, 0.0, 0.0, 60.0), (1, 200.0, 300.0, 45.0)], "target int, x double, y double, radius double")
    got = planner.quadrant(targets, planner.azimuth_steps(spark, 45.0)).orderBy("azimuth").collect()
    assert [r.azimuth for r in got] == [0, 45, 90] and all(r.verdict != "missed" and abs(r.none + r.once - 1) < 1e-9 and r.none == 0 and r.twice == 1 for r in got)  # double keeps its promise to the edge
    for mode, least in (("recon", 0), ("full", 1), ("double", 2)):
        assert all(r.worst >= least for r in planner.quadrant(targets, planner.azimuth_steps(spark, 45.0), planner.Sonar(mode=mode)).collect())
    boxes = planner.plan_boxes(targets, planner.azimuth_steps(spark, 45.0), sonar)
    runs = planner.plan_runs(planner.plan_lines(boxes), planner.Rig())
    one = runs.where("azimuth = 0").orderBy("run").collect()
    assert [x.heading for x in one[:3]] == [0, 180, 0] and all(abs(abs(x.ends - x.starts) - x.length) < 1e-9 and x.on == (x.starts + x.dir * (150 + 54)) for x in one)
    assert planner.fish_short(planner.Rig()) == 0 and planner.fish_short(planner.Rig(run_out_m=10.0)) == 44
    bent = planner.plan_turns(runs).where("azimuth = 0").orderBy("run").collect()
    assert len(bent) == len(one) - 1
    for t, a, b in zip(bent, one, one[1:]):
        assert t.points[0] == [a.ends, a.u] and math.dist(t.points[-1], (b.starts, b.u)) < 1e-6 and t.length >= math.dist((a.ends, a.u), (b.starts, b.u))
    back = planner.plan_turns(planner.plan_runs(planner.plan_lines(boxes), planner.Rig(), one_way=True)).where("azimuth = 0").collect()
    assert min(t.length for t in back) > max(x.length for x in one)
    wide = planner.Sonar(mode="custom", spacing_m=150.0)
    assert not wide.twice and planner.Sonar(mode="custom", spacing_m=60.0).twice
    open_boxes = planner.plan_boxes(targets, planner.azimuth_steps(spark, 45.0), wide)
    assert planner.gaps(open_boxes, planner.plan_lines(open_boxes), wide).count() > 0 and planner.gaps(boxes, planner.plan_lines(boxes), sonar).count() == 0


def test_contacts(spark):
    df = spark.createDataFrame([("Two wrecks!",), ("Sand waves",), ("minefield",), (None,), ("Unexploded ordnance",), ("Non-mines",), ("MILCO",)], "t string")
    assert [r.g for r in df.select(contacts.class_group(F.col("t")).alias("g")).collect()] == ["wreck", "seabed", None, None, "ordnance", "cleared", "suspect"]
    ids = spark.createDataFrame([("C001", 1), ("C010", 2), ("X999", 3), ("Cfoo", 4)], "id string, k int")
    assert contacts.next_id(ids).first().id == "C011" and contacts.next_id(ids.limit(0)).first().id == "C001"
    assert sorted((r.id, r.k) for r in contacts.upsert(ids, spark.createDataFrame([("C010", 9)], "id string, k int")).collect())[1] == ("C010", 9)
    tree = spark.createDataFrame([("a", None, True), ("b", "a", False), ("c", "b", True), ("d", "a", True)], "id string, parent string, shown boolean")
    assert sorted(r.id for r in contacts.visible(tree).collect()) == ["a", "d"]
    assert contacts.fingerprint({"a": 1}) == contacts.fingerprint({"a": 1}) != contacts.fingerprint({"a": 2})


def test_pings(spark):
    df = spark.createDataFrame([(20, 0, 0.0, 0, 10.0, 20.0), (20, 0, 0.5, 1, 30.0, 40.0), (20, 1, 0.6, 2, 0.0, 0.0), (21, 0, 0.1, 3, 0.0, 0.0)], "subsystem int, channel int, time double, rec_id long, f0 double, f1 double")
    got = {r.subsystem: (r.pings, r.f0, r.f1) for r in pings.bands(df).collect()}
    assert got == {20: (3, 30.0, 40.0), 21: (1, None, None)}
    assert pings.ping_interval(df).first().interval == 0.5


def test_layers(spark):
    from seabright.functions import geodesy as geo
    from seabright.operators import layers

    assert layers.zoom_for(1.0, 0.0) == 18
    cells = spark.createDataFrame([(i, j, float(i + j)) for i in range(20) for j in range(20)], "gx long, gy long, value double")
    assert layers.statistics(cells).first().filled == 400
    assert {r.code for r in layers.codes(cells).collect()} >= {0, 65534}
    flat = spark.createDataFrame([(i, j, float(i)) for i in range(5) for j in range(5)], "gx long, gy long, value double")
    shade = {(r.gx, r.gy): r.shade for r in layers.relief(flat, 1.0).collect()}
    assert len(shade) == 25 and shade[0, 0] == 1.0 and abs(shade[2, 2] - shade[1, 2]) < 1e-12 and shade[2, 2] > 0
    assert abs(geo.MERCATOR_RADIUS - 6378137) < 1


def test_tow_models(spark):
    df = spark.createDataFrame([("d", i, float(i), 52.5 + i * 2e-5, 4.0) for i in range(300)], "dataset string, seq long, time double, lat double, lon double")
    track = navigation.track(df).cache()
    last = navigation.trailing(track, 44.0).orderBy(F.desc("seq")).first()
    assert abs((last.lat - last.fish_lat) * 111_260 - 44) < 0.1 and abs(last.fish_lon - 4) < 1e-9
    assert navigation.model_spread(track, 44.0, 50).first().middle < 0.01
    steps = [r.advance_m for r in navigation.advance(df.withColumnRenamed("seq", "row")).orderBy("row").collect()]
    assert steps[0] == 0 and abs(steps[1] - 2.2252) < 0.001
    turn = spark.createDataFrame([("d", i, float(i), (350.0 + 5 * i) % 360) for i in range(6)] + [("d", 9, 0.0, 99.0)], "dataset string, rec_id long, time double, heading double")
    got = [r.heading for r in navigation.compass(turn, 2.0).orderBy("time").collect()]
    assert got == [352.5, 355.0, 360.0, 365.0, 370.0, 372.5]


def test_courses_keep_their_places_far_from_the_origin(spark):
    """Metres of a place on the earth have no digits left for a course of a few metres; those from the first fix do."""
    seq = np.arange(40)
    lat, lon = 52.5 + seq * 1e-4 + (seq * 5 % 7) * 1e-5, 4.0 + (seq * 11 % 13) * 1e-5 + seq * 5e-5
    got = navigation.track(spark.createDataFrame([(1, s, s * 60.0, a, b) for s, a, b in zip(seq.tolist(), lat.tolist(), lon.tolist(), strict=True)], "dataset long, seq long, time double, lat double, lon double")).orderBy("seq").toPandas()
    wide = np.longdouble
    m, e2 = np.radians(lat.astype(wide).mean()), (1 / wide(298.257223563)) * (2 - 1 / wide(298.257223563))
    north, east = (1 - e2) / (1 - e2 * np.sin(m) ** 2) ** wide(1.5), np.cos(m) / np.sqrt(1 - e2 * np.sin(m) ** 2)
    a, b = np.maximum(seq - 2, 0), np.minimum(seq + 2, 39)
    want = np.degrees(np.arctan2((lon.astype(wide)[b] - lon[a]) * east, (lat.astype(wide)[b] - lat[a]) * north))
    assert np.abs(got["cog"].to_numpy() - want).max() < 2e-12


def test_a_tow_is_followed_over_many_recordings_at_once(spark):
    """No call for each recording; fixes before the first movement, and recordings that never move, are in the result."""
    rows = [(d, n, 0.0 if n < 3 else (n - 2) * 10.0 * (d > 0), 0.0) for d in range(50) for n in range(6)] + [(None, 0, 1.0, 1.0)]
    fixes = spark.createDataFrame(rows, "dataset long, seq long, x double, y double")
    found = navigation.pursuit(fixes, 20.0, 5.0)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.dataset, r.seq): (round(r.fish_x, 6), round(r.fish_y, 6)) for r in found.collect()}
    assert len(got) == len(rows) and got[None, 0] == (1.0, -19.0)
    assert all(got[d, n] == ((-20.0 + max(n - 2, 0) * 10.0, 0.0) if d else (0.0, -20.0)) for d in range(50) for n in range(6))


def test_tasks_of_courses_follow_the_fixes(spark, monkeypatch):
    monkeypatch.setattr(navigation, "FIXES_A_TASK", 10)
    fixes = spark.range(300).selectExpr("id % 30 as dataset", "id div 30 as seq", "id * 1.0D as time", "52.5D as lat", "4.0D + id * 1e-5 as lon")
    assert "REPARTITION_BY_NUM" in navigation.track(fixes)._jdf.queryExecution().executedPlan().toString() and navigation._dealt(fixes).rdd.getNumPartitions() == 30
