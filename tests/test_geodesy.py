import math

import pytest
from pyspark.sql import functions as F

from seabright.functions import acoustics as ac
from seabright.functions import geodesy as geo

# Positions and their coordinates, with the tolerance in metres.
KNOWN = [
    (3857, 52.5, 4.02, 447504.3529889597, 6891041.723891586, 0.001), (32631, 52.5, 4.02, 569239.7873288931, 5817140.985190725, 0.001),
    (28992, 52.5, 4.02, 62164.141635303706, 502243.44995967386, 1.5), (3035, 52.5, 4.02, 3915417.9845896605, 3282315.345882396, 0.001),
    (23031, 52.5, 4.02, 569331.5259353155, 5817351.2824040875, 3.0), (25831, 52.5, 4.02, 569239.78732961, 5817140.985066774, 0.001),
    (32631, 52.62, 4.10, 574466.7069679797, 5830568.07383273, 0.001), (28992, 52.62, 4.10, 67833.38906237867, 515494.7043924899, 1.5),
]


@pytest.mark.parametrize("epsg, lat, lon, x, y, within", KNOWN)
def test_known_places(spark, epsg, lat, lon, x, y, within):
    row = geo.with_projected(spark.createDataFrame([(lat, lon)], "lat double, lon double"), epsg, "lat", "lon", "x", "y").first()
    assert abs(row.x - x) < within and abs(row.y - y) < within
    back = geo.to_wgs84(epsg, F.col("x"), F.col("y"))
    there = spark.createDataFrame([(row.x, row.y)], "x double, y double").select(back[0].alias("lat"), back[1].alias("lon")).first()
    assert abs(there.lat - lat) < 1e-5 and abs(there.lon - lon) < 1e-5


def test_distances(spark):
    df = spark.createDataFrame([(52.5, 4.0)], "lat double, lon double")
    lat, lon = geo.offset_m(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(1000.0))
    row = df.select(lat.alias("a"), lon.alias("b"), "lat", "lon").select(
        geo.distance_m(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")).alias("d"), geo.haversine_m(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")).alias("h"), geo.initial_bearing(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")).alias("brg")
    ).first()
    assert abs(row.d - 1000) < 0.1 and abs(row.h - 1000) < 4 and abs(row.brg - 30) < 0.2


def test_text(spark):
    row = spark.range(1).select(geo.to_dms(F.lit(52.99999999), "N", "S").alias("a"), geo.to_dm(F.lit(-4.5), "E", "W").alias("b"), geo.utm_epsg(F.lit(-1.0), F.lit(4.0)).alias("c")).first()
    assert tuple(row) == ("53°00'00.0\"N", "4°30.000'W", 32731)


def test_tiles(spark):
    px, py = geo.lonlat_to_px(F.lit(4.0), F.lit(52.5), 10)
    lon, lat = geo.px_to_lonlat(px, py, 10)
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), geo.tiles_for(F.lit(3.9), F.lit(52.4), F.lit(4.1), F.lit(52.6), 10).alias("t")).first()
    assert abs(row.lon - 4) < 1e-9 and abs(row.lat - 52.5) < 1e-9 and len(row.t) in (2, 4)


def test_acoustics(spark):
    row = spark.range(1).select(ac.absorption_db_per_km(F.lit(580.0), 20.0, 34.0, 20.0).alias("a"), ac.absorption_db_per_km(F.lit(1550.0), 20.0, 34.0, 20.0).alias("b")).first()
    assert abs(row.a - 164) < 8 and abs(row.b - 622) < 30
    assert abs(ac.temperature_from_sound_speed(ac.mackenzie(11.5, 34, 20), 34, 20) - 11.5) < 1e-6
    assert math.isclose(spark.range(1).select(ac.tvg_gain(F.lit(10.0), 10.0, 0.1, 1.0).alias("g")).first().g, 1.0)


def test_the_sql_of_printed_places_has_the_whole_european_box(spark, tmp_path):
    """From 34 to 72 degrees, both ends in it, as the query has it and the reference (crs.rs)."""
    import duckdb

    from seabright.plans import registry

    spark.createDataFrame([(k,) for k in (1517, 2027, 4237, 119, 629)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["printed_places"](spark, str(tmp_path)).select("c_custkey", "bridge", "systems", "far").collect()
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(f"select c_custkey, bridge, systems, far from ({registry.ORACLE_SQL['printed_places']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and any("3035" in r.systems and r.bridge.startswith("N72") for r in got)
