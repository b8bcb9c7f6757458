import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seabright.functions import geodesy as geo
from seabright.operators import imaging, navigation, survey, waterfall

RES, N = 0.05, 600


def pixel(lon, lat, zoom=19):
    size = 256.0 * 2**zoom
    return (lon + 180) / 360 * size, (0.5 - math.atanh(math.sin(math.radians(lat))) / (2 * math.pi)) * size


@pytest.fixture(scope="module")
def line(spark):
    """A ship going north at 2 m/s over a flat bottom 6 m under the fish, with a bright thing 20 m to starboard, 100 m along."""
    rng, pings, traces = np.random.default_rng(6), [], []
    interval = RES * 2 / 1500 * 1e9
    for k in range(1200):
        t = k * 0.1
        lat = 52.5 + math.floor(t) * 2 / 111_270  # a fix a second
        for side in (0, 1):
            rec = 2 * k + side
            echo = rng.random(N) * 2 + 50
            echo[: int(6 / RES)] = rng.random(int(6 / RES)) * 0.5
            along = t * 2 - 54 - 100
            if side == 1 and abs(along) < 1.5:
                at = int(math.hypot(20, 6) / RES)
                echo[at - 4 : at + 5] = 5000
            pings.append(("d", rec, 1000 + t + side * 1e-3, 20, side, lat, 4.0, 0.0, 30.0 if 300 <= k < 320 else 0.0, 65, 6.0, 5.0, N, int(interval), 400_000.0, 420_000.0))
            traces.append((rec, echo.tolist()))
    df = spark.createDataFrame(pings, "dataset string, rec_id long, time double, subsystem long, channel long, lat double, lon double, heading double, roll double, validity int, altitude double, depth double, nsamples long, interval_ns long, f0 double, f1 double").cache()
    return df, spark.createDataFrame(traces, "rec_id long, data array<double>").cache()


def test_the_bright_thing_lies_where_it_is(spark, line):
    pings, traces = line
    picture = survey.Picture(across=512, angular=0.7)
    got = survey.build(pings, traces, picture, 0.1).collect()
    north, east = 111_268.0, 67_910.0
    x, y = pixel(4.0 + 20 / east, 52.5 + 100 / north)
    top = max(got, key=lambda r: r.value)
    metre = 1 / (156_543.034 / 2**19 * math.cos(math.radians(52.5)))
    assert math.hypot(top.gx - x, top.gy - y) < 3 * metre
    box = survey.extents(pings, picture).first()
    assert all(box.x0 <= r.gx < box.x0 + box.width and box.y0 <= r.gy < box.y0 + box.height for r in got)
    west = min(r.gx for r in got)
    assert abs(pixel(4.0 - 29.5 / east, 52.5)[0] - west) < 2 * metre
    alpha = survey.absorption(pings, picture)
    assert 0.08 < alpha < 0.13  # 410 kHz in the sea
    assert survey.absorption(pings, survey.Picture(tvg=0.0)) == 0.0


def test_flagged_pings_and_looks(spark, line):
    pings, traces = line
    steady = survey.paired(pings, traces, survey.Picture(), 0.1)
    assert steady.count() == 1180 and steady.where("usable").count() == 1180
    assert survey.paired(pings, traces, survey.Picture(drop_flagged=False), 0.1).count() == 1200
    away = survey.paired(pings, traces, survey.Picture(look=(180.0, 30.0)), 0.1)
    assert away.where("usable").count() == 0 and away.count() == 1180
    assert survey.paired(pings, traces, survey.Picture(most_turn=0.5), 0.1).where("usable").count() == 1180
    row = steady.where("row = 600").first()
    assert row.resolution_m == pytest.approx(RES, rel=1e-4) and row.prior == pytest.approx(6 / RES, rel=1e-3) and abs((row.bearing + 180) % 360 - 180) < 0.5
    with pytest.raises(Exception, match="lower the zoom"):
        survey.extents(pings, survey.Picture(zoom=26)).collect()


def test_models_of_the_tow_agree_on_a_straight_line(spark, line):
    pings, _ = line
    late = F.col("rec_id") == 2300
    places = {m: survey.fixes(pings, survey.Tow(model=m)).where(late).first() for m in ("astern", "wake", "tractrix")}
    assert all(abs(p.lat - places["astern"].lat) * 111_268 < 1.2 and abs(p.lon - 4.0) < 1e-7 for p in places.values())
    assert survey.fixes(pings, survey.Tow(bearing="compass", heading_offset=5.0)).where(late).first().bearing == pytest.approx(5.0)
    known = navigation.fix_track(pings).select("dataset", F.col("rec_id").alias("seq"), "time", "lat", "lon")
    spread = navigation.model_spread(navigation.track(known), 44.0, 20, 10.0).first()
    assert spread.middle < 0.3 <= 0.3 + spread.most


def test_angle_samples_are_an_even_choice(spark, line):
    pings, traces = line
    lines = survey.paired(pings, traces, survey.Picture(), 0.1)
    sampled = waterfall.angle_samples(lines, 64, 0.0)
    n = sampled.count()
    assert 0 < n <= 1199 * 64
    curves = imaging.angle_gain(sampled, 1.0, by=("dataset", "side")).collect()
    assert {(r.dataset, r.side) for r in curves} == {("d", -1), ("d", 1)} and all(len(r.curve) == 90 and abs(np.median(r.curve) - 1) < 0.05 for r in curves)
    assert geo.MERCATOR_RADIUS == 6_378_137.0
