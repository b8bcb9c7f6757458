"""Registered queries of the image measures and readouts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.functions import acoustics as ac
from seabright.functions import geodesy as geo
from seabright.operators import imaging, waterfall
from seabright.plans import views as v
from seabright.plans.survey_views import _E, _N, _TRACK, _dist, query, r


@query(f"""
with {v.TRACES}, c as (select setting, unnest(data) as x, unnest(range(len(data))) as col from v_traces), l as (select setting, col, quantile_cont(x, 0.5) as level from c group by all),
f as (select setting, quantile_cont(level, 0.05) filter (level > 0) as floor from l group by 1), g as (select l.setting, list(greatest(level, floor) order by col) as a from l join f using (setting) group by 1)
select setting, list_transform(range(64), lambda i: round(((a[greatest(i - 1, 0) + 1] + a[i + 1] + a[least(i + 1, 63) + 1]) / 3) ** 0.7, 5)) as profile from g
""")
def gain_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.column_profile(v.traces(spark, sf_dir), 64, 0.7).select("setting", F.transform("profile", lambda x: F.round(x, 5)).alias("profile"))


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the traces of one recording, port and starboard by turns, flown so low that the bottom is where it was recorded; their gain by angle."""
    k = F.col("rec_id")
    side = lambda n: F.when(k % 2 == n, F.col("data"))
    rows = v.traces(spark, sf_dir).select(F.lit(0).alias("dataset"), k.alias("row"), side(0).alias("port"), side(1).alias("stbd"), (1.5 + k % 3 * 0.5).alias("altitude_m"), F.lit(0.5).alias("resolution_m"))
    return imaging.angle_gain(waterfall.angle_samples(rows, 64, 0.7, 0.01), 0.8)


_ANGLES = f"""{v.TRACES}, k as (select *, row_number() over (order by rec_id) - 1 as k, count(*) over () as n from v_traces),
s as (select case when rec_id % 2 = 0 then -1 else 1 end as side, 1.5::double + rec_id % 3 * 0.5::double as alt, data, unnest(range(32)) + 0.5::double as place from k where k % greatest(n // 600, 1) = 0),
d as (select *, sqrt(place ** 2 + alt ** 2) as slant from s), x as (select *, slant / 0.5::double as spot, cast(floor(slant / 0.5::double) as bigint) as i from d where slant / 0.5::double < 63),
v as (select side, place, alt, (data[i + 1] + (data[i + 2] - data[i + 1]) * (spot - i)) * 10::double ** (0.7::double * (30 * log10(slant / alt) + 2 * 0.01::double * (slant - alt)) / 20) as amp from x),
t as (select side, least(cast(floor(degrees(atan2(place, alt))) as bigint), 89) as bin, amp from v where amp > 0),
b as (select side, bin, quantile_cont(amp, 0.5) as level from t group by all having count(*) >= 20 and quantile_cont(amp, 0.5) > 0), e as (select distinct side, unnest(range(90)) as bin from t),
j as (select e.side, e.bin, b.level from e left join b using (side, bin)),
f as (select side, bin, coalesce(last_value(level ignore nulls) over (partition by side order by bin rows unbounded preceding), first_value(level ignore nulls) over (partition by side order by bin rows between current row and unbounded following)) as level from j),
p as (select side, list(greatest(level, lo) order by bin) as a from f join (select side, quantile_cont(level, 0.05) as lo from f group by 1) using (side) group by 1),
m as (select side, list_transform(range(90), lambda i: (a[greatest(i-3,0)+1]+a[greatest(i-2,0)+1]+a[greatest(i-1,0)+1]+a[i+1]+a[least(i+1,89)+1]+a[least(i+2,89)+1]+a[least(i+3,89)+1]) / 7) as c from p),
v_angles as (select side, list_transform(c, lambda x: greatest(x / ((list_sort(c)[45] + list_sort(c)[46]) / 2), 1e-3) ** 0.8) as curve from m)"""


@query(f"with {_ANGLES} select side, list_transform(curve, lambda x: round(x, 6)) as curve from v_angles")
def angle_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _angles(spark, sf_dir).select("side", F.transform("curve", lambda x: F.round(x, 6)).alias("curve"))


@query(f"""
with {_ANGLES}, q as (select l_orderkey, l_linenumber, least(greatest(l_quantity * 1.9 - 0.5, 0), 89)::double as x, case when l_suppkey % 2 = 0 then -1 else 1 end as side from lineitem)
select l_orderkey, l_linenumber, round(curve[least(floor(x), 88)::int + 1] + (curve[least(floor(x), 88)::int + 2] - curve[least(floor(x), 88)::int + 1]) * (x - least(floor(x), 88)), 6) as gain from q join v_angles using (side)
""")
def angle_gain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = _angles(spark, sf_dir)
    rows = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.9).alias("theta"), F.when(F.col("l_suppkey") % 2 == 0, -1).otherwise(1).alias("side"))
    return rows.join(F.broadcast(curves), "side").select("l_orderkey", "l_linenumber", r(imaging.angle_gain_at(F.col("curve"), F.col("theta")), name="gain"))


@query(f"""
with {v.PINGS} select rec_id, round(nsamples * interval_ns * 1e-9::double * case when rec_id % 3 = 0 then 1500 else 1480 + rec_id % 40 end / 2, 8) as slant, abs((rec_id * 7) % 31 - 15) <= 11 as clean,
abs((heading - 90 + 180) - 360 * floor((heading - 90 + 180) / 360) - 180) <= 40 and abs((rec_id % 13) / 4::double) <= 2 as looks from v_pings
""")
def ping_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("rec_id")
    speed = F.when(k % 3 == 0, 0.0).otherwise(1480.0 + k % 40)
    return v.pings(spark, sf_dir).select(
        "rec_id", r(imaging.recorded_slant_m(F.col("nsamples"), F.col("interval_ns"), speed), 8, "slant"), imaging.steady_roll((k * 7) % 31 - 15).alias("clean"),
        imaging.in_look_window(F.col("heading"), 90.0, 40.0, (k % 13) / 4, 2.0).alias("looks"),
    )


@query(f"""
with {v.PINGS}, a as (select dataset, list(altitude order by altitude) as l from v_pings where (validity & 64) <> 0 and altitude > 0 group by 1), s as (select dataset, list(nsamples * interval_ns * 1e-9::double * 750 order by nsamples * interval_ns) as l from v_pings group by 1),
m as (select dataset, a.l[len(a.l) // 2 + 1] as alt, s.l[len(s.l) // 2 + 1] as slant from a join s using (dataset))
select dataset, round(alt, 6) as altitude, round(alt * tan(radians(32)), 5) as near_m, round(least(sqrt(greatest(slant ** 2 - alt ** 2, 0)), alt * tan(radians(82))), 5) as far_m from m
""")
def beam_reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.pings(spark, sf_dir)
    return imaging.median_altitude(p, "dataset").join(imaging.beam_reach(p, "dataset"), "dataset").select("dataset", r("altitude"), r("near_m", 5), r("far_m", 5))


_PX, _PY = "({lon} + 180) / 360 * 256 * 2 ** 19", "(0.5::double - atanh(sin(radians({lat}))) / (2 * pi())) * 256 * 2 ** 19"


@query(f"""
with {v.PINGS}, b as (select dataset, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e, (max(nsamples * interval_ns * 1e-9::double * 750) + 54) * 1.3::double as margin from v_pings where lat <> 0 or lon <> 0 group by 1),
d as (select *, margin / ({_N.format(m='((s + n) / 2)')}) as dn, margin / ({_E.format(m='((s + n) / 2)')}) as de from b),
p as (select dataset, {_PX.format(lon='(w - de)')} as x0, {_PX.format(lon='(e + de)')} as x1, {_PY.format(lat='(n + dn)')} as y0, {_PY.format(lat='(s - dn)')} as y1 from d)
select dataset, cast(floor(x0) as bigint) as x0, cast(floor(y0) as bigint) as y0, cast(ceil(x1) - floor(x0) + 1 as bigint) as width, cast(ceil(y1) - floor(y0) + 1 as bigint) as height from p
""")
def raster_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.raster_extent(v.pings(spark, sf_dir), 19, 54.0, "dataset")


@query(f"""
with {v.FIXES}, c as (select cast(floor({_PX.format(lon='lon')} / 4) as bigint) * 4 + l_linenumber % 4 as gx, cast(floor({_PY.format(lat='lat')} / 4) as bigint) * 4 + l_linenumber % 3 as gy, avg(l_quantity) as value from v_fixes join lineitem on l_orderkey = seq + 1 group by all)
select f.dataset, f.seq, round(c.value, 5) as value from v_fixes f left join c on cast(floor({_PX.format(lon='lon')}) as bigint) = c.gx and cast(floor({_PY.format(lat='lat')}) as bigint) = c.gy
""")
def sampled_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.fixes(spark, sf_dir)
    x, y = geo.lonlat_to_px(F.col("lon"), F.col("lat"), 19)
    made = f.join(v.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("seq") + 1)
    cells = made.select((F.floor(x / 4) * 4 + F.col("l_linenumber") % 4).alias("gx"), (F.floor(y / 4) * 4 + F.col("l_linenumber") % 3).alias("gy"), "l_quantity").groupBy("gx", "gy").agg(F.avg("l_quantity").alias("value"))
    return imaging.sample_raster(cells, f, 19).select("dataset", "seq", r("value", 5))


@query("""
with c as (select l_partkey % 512 as gx, l_suppkey * 37 % 512 as gy, cast(max(l_quantity) as bigint) as value from lineitem group by all)
select gx // 64 as gx, gy // 64 as gy, cast(sum(value) // count(*) as integer) as value from c where gx % 4 = 0 and gy % 4 = 0 group by 1, 2
""")
def tile_subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = v.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 512).alias("gx"), (F.col("l_suppkey") * 37 % 512).alias("gy")).agg(F.max("l_quantity").cast("long").alias("value"))
    return imaging.tile_pixels(cells, 6)


@query(f"""
with {v.FIXES}, s as (select dataset, seq, {_dist('pl', 'po', 'lat', 'lon')} as step from (select *, lag(lat) over w as pl, lag(lon) over w as po from v_fixes window w as (partition by dataset order by seq))),
l as (select dataset, list(step order by step) as l from s where step > 0 group by 1) select dataset, round(l[len(l) // 2 + 1], 4) as metres from l
""")
def row_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.metres_per_row(v.fixes(spark, sf_dir).withColumnRenamed("seq", "row")).select("dataset", r("metres", 4))


@query(f"""
with {v.PINGS}, n as (select dataset, time, row_number() over (partition by dataset order by time, rec_id) - 1 as row from v_pings), m as (select dataset, min(time) as t0, max(time) as t1, max(row) as k from n group by 1)
select dataset, cast(k as bigint) as last_row, round(case when k > 0 then (t1 - t0) / k else 0 end, 6) as seconds, round(case when k > 0 then 3600 / ((t1 - t0) / k) else 0 end, 6) as row_after_an_hour from m
""")
def time_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = v.pings(spark, sf_dir).withColumn("row", F.row_number().over(Window.partitionBy("dataset").orderBy("time", "rec_id")) - 1)
    last = rows.groupBy("dataset").agg(F.max("row").cast("long").alias("last_row"))
    m = imaging.time_model(rows).join(last, "dataset")
    return m.select("dataset", "last_row", r("seconds"), r(imaging.row_of_time(F.col("time0") + 3600, F.col("row0"), F.col("time0"), F.col("seconds")), name="row_after_an_hour"))


@query("select c_custkey, case when m / p >= 5 then 5 * p when m / p >= 2 then 2 * p else p end as nice from (select c_custkey, m, 10::double ** floor(log10(m)) as p from (select c_custkey, c_custkey * 3.7::double as m from customer where c_custkey > 0))")
def nice_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey", imaging.nice_distance(F.col("c_custkey") * 3.7).alias("nice"))


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey::varchar desc) as n from orders) where n <= 4")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = v.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("modified"), F.col("o_orderkey").cast("string").alias("path"))
    return imaging.newest(files, 4, "o_custkey").select("o_custkey", "o_orderkey")


@query("select n_nationkey, row_number() over (order by n_regionkey % 2, n_nationkey desc) as drawn from nation")
def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = v.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("place"), F.when(F.col("n_regionkey") % 2 == 0, "tiles").otherwise("vectors").alias("kind"))
    return imaging.draw_order(layers).select("n_nationkey", F.col("drawn").cast("long").alias("drawn"))


@query("""
with b as (select event_id as place, user_id % 7 as subsystem, case when event_id % 5 = 0 then 0 else 100000 + event_id % 4 * 1000 end::double as centre from events where event_id < 1000000000)
select subsystem, coalesce(arg_min(centre, place) filter (centre > 0), 0) as centre from b group by 1
""")
def band_centres_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    b = v.table(spark, sf_dir, "events").select(k.alias("place"), (F.col("user_id") % 7).alias("subsystem"), F.when(k % 5 == 0, 0.0).otherwise(100000.0 + k % 4 * 1000).alias("centre"))
    return imaging.merged_bands(b)


@query(f"""
with {v.FIXES}, c as (select dataset, avg(lat) as lat0, avg(lon) as lon0 from v_fixes group by 1)
select dataset, seq, round((lon - lon0) * {_E.format(m='lat0')}, 4) + 0 as east, round((lat - lat0) * {_N.format(m='lat0')}, 4) + 0 as north from v_fixes join c using (dataset)
""")
def local_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.fixes(spark, sf_dir)
    rows = f.join(imaging.centroid(f, "dataset").toDF("dataset", "lat0", "lon0"), "dataset")
    east, north = imaging.in_frame(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return rows.select("dataset", "seq", r(east, 4, "east"), r(north, 4, "north"))


@query("select c_custkey, cast(case when c_custkey % 4 = 3 then 0 else c_custkey % 4 end as integer) as features from customer")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    made = F.array_join(F.array_repeat(F.lit('{"type":"Feature"}'), k.cast("int")), ",")
    document = F.when(k == 3, "no json").otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":['), made, F.lit("]}")))
    return v.table(spark, sf_dir, "customer").select("c_custkey", imaging.count_features(document).alias("features"))


@query("""
select c_custkey, round(case c_custkey % 9 when 0 then d + m / 60::double + s / 3600::double when 1 then -(d + m / 60::double) when 2 then -(d + 0.5) when 3 then d + m / 60::double + s / 3600::double when 4 then d + (m + 0.25) / 60::double end, 8) as degrees
from (select c_custkey, c_custkey % 80 as d, c_custkey % 60 as m, c_custkey * 7 % 60 as s from customer)
""")
def parsed_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine ways of writing a place, the last four of which are none."""
    k = F.col("c_custkey")
    d, m, s = ((x).cast("string") for x in (k % 80, k % 60, k * 7 % 60))
    two = lambda x: F.lpad(x, 2, "0")
    ways = [
        F.concat(d, F.lit("° "), m, F.lit("' "), s, F.lit('" N')), F.concat(F.lit("W "), d, F.lit(" "), m), F.concat(F.lit("-"), d, F.lit(".5")), F.concat(d, F.lit(":"), m, F.lit(":"), s, F.lit("E")), F.concat(two(d), two(m), F.lit(".25")),
        F.concat(F.lit("N "), d), F.concat(F.lit("+"), d), F.concat(F.lit("1"), two(d), F.lit(".5")), F.concat(d, F.lit(" 75")),
    ]
    text = F.element_at(F.array(*ways), (k % 9 + 1).cast("int"))
    degrees = F.when((k % 9).isin(1, 3, 5), imaging.parsed_coordinate(text, False)).otherwise(imaging.parsed_coordinate(text, True))
    return v.table(spark, sf_dir, "customer").select("c_custkey", r(degrees, 8, "degrees"))


@query("""
with p as (select c_custkey, c_custkey % 170 - 85 as lat, c_custkey * 7 % 359 - 179 as lon from customer)
select c_custkey, case when lat < 0 then 'S' else 'N' end || lpad(cast(abs(lat) as varchar), 2, '0') || '30.0000' as bridge,
    '4326 ' || (case when lat < 0 then 32700 else 32600 end + (lon + 180) // 6 + 1) || case when lat between 50 and 54 and lon between 3 and 8 then ' 28992' else '' end || case when lat between 34 and 72 and lon between -25 and 45 then ' 3035 23031' else '' end as systems,
    case when c_custkey >= 10000 then (c_custkey + 500) // 1000 || ' km' when c_custkey >= 1000 then (c_custkey + 5) // 1000 || '.' || lpad(cast((c_custkey + 5) // 10 % 100 as varchar), 2, '0') || ' km' when c_custkey >= 100 then c_custkey || ' m' when c_custkey >= 1 then c_custkey || '.0 m' else '0 cm' end as far
from p
""")
def printed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = k % 170 - 85, k * 7 % 359 - 179
    half = F.when(lat < 0, lat - 0.5).otherwise(lat + 0.5)
    return v.table(spark, sf_dir, "customer").select(
        "c_custkey", imaging.bridge_coordinate(half, True).alias("bridge"), F.concat_ws(" ", geo.suggested_systems(lat.cast("double"), lon.cast("double")).cast("array<string>")).alias("systems"),
        imaging.distance_text(k.cast("double")).alias("far"),
    )


@query("""
with k as (select p_partkey, p_size * 20 + 100 as f, p_size as r from part), c as (select 1412 + 3.21 * 20 + 1.19 * 34 + 0.0167 * 20 as c, 2.8 * sqrt(34 / 35::double) * 10::double ** (4 - 1245 / 293::double) as f1, 8.17 * 10::double ** (8 - 1990 / 293::double) / (1 + 0.0018 * (34 - 35)) as f2),
w as (select c, f1, f2, 8.86 / c * 10::double ** (0.78 * 8 - 5) as a1, 21.44 * 34 / c * (1 + 0.025 * 20) as a2, 1 - 1.37e-4 * 20 + 6.2e-9 * 400 as p2, 4.937e-4 - 2.59e-5 * 20 + 9.11e-7 * 400 - 1.50e-8 * 8000 as a3, 1 - 3.83e-5 * 20 + 4.9e-10 * 400 as p3 from c)
select p_partkey, round(a1 * f1 * f * f / (f1 * f1 + f * f) + a2 * p2 * f2 * f * f / (f2 * f2 + f * f) + a3 * p3 * f * f, 4) as db_per_km, round(10::double ** (0.7 * (30 * log10(r / 10::double) + 0.2 * (r - 10)) / 20), 6) as gain from k, w
""")
def sound_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    khz = F.col("p_size") * 20 + 100
    return v.table(spark, sf_dir, "part").select("p_partkey", r(ac.absorption_db_per_km(khz.cast("double"), 20.0, 34.0, 20.0), 4, "db_per_km"), r(ac.tvg_gain(F.col("p_size").cast("double"), 10.0, 0.1, 0.7), 6, "gain"))


_PROBES = "(values (0, 52.501::double, 4.002::double), (1, 52.508::double, 4.009::double))"


@query(f"""
with {v.PINGS}, p as (select * from {_PROBES} t(probe, at_lat, at_lon)), d as (select probe, rec_id, round(sqrt(((lat - at_lat) * {_N.format(m='at_lat')}) ** 2 + ((lon - at_lon) * {_E.format(m='at_lat')}) ** 2), 6) as d from v_pings, p where lat <> 0)
select probe, arg_min(rec_id, struct_pack(d, rec_id)) as row from d group by 1
""")
def nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seabright.operators import rows

    p = v.pings(spark, sf_dir).where("lat <> 0").select(F.col("rec_id").alias("row"), "lat", "lon")
    probes = spark.createDataFrame([(0, 52.501, 4.002), (1, 52.508, 4.009)], "probe int, at_lat double, at_lon double")
    return rows.nearest_in_place(p, probes)


@query(f"""
with {v.PINGS}, p as (select * from {_PROBES} t(point, at_lat, at_lon)), m as (select point, rec_id, heading, (at_lat - lat) * {_N.format(m='lat')} as n, (at_lon - lon) * {_E.format(m='lat')} as e from v_pings, p where lat <> 0),
a as (select point, rec_id, round(abs(n * cos(radians(heading)) + e * sin(radians(heading))), 6) as along, e * cos(radians(heading)) - n * sin(radians(heading)) as across from m), k as (select *, row_number() over (partition by point order by along, rec_id) as place from a where abs(across) <= 120)
select point, round((across / 120 + 1) / 2 * 1024, 4) as x, rec_id + 0.5::double as y from k where place = 1
""")
def located_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seabright.operators import rows

    p = v.pings(spark, sf_dir).where("lat <> 0").select(F.col("rec_id").alias("row"), "lat", "lon", F.col("heading").alias("bearing"), F.lit(8.0).alias("altitude"), F.lit(120.0).alias("half_width_m"))
    points = spark.createDataFrame([(0, 52.501, 4.002), (1, 52.508, 4.009)], "point int, at_lat double, at_lon double")
    return rows.world_to_pixel(p, points, 1024).select("point", r("x", 4), F.col("y").cast("double").alias("y"))
