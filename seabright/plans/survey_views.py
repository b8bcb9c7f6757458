"""Registered survey queries over the driver's tables, each with the SQL that checks it. Floating results are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seabright.functions import acoustics as ac
from seabright.functions import arrays as ar
from seabright.functions import geodesy as geo
from seabright.operators import contacts, mosaic, navigation, pings, planner, rows, waterfall
from seabright.operators.quantiles import quantiles
from seabright.plans import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def r(c: str | Column, places: int = 6, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)  # no negative zero
    return out.alias(name or (c if isinstance(c, str) else "v"))


@query(f"""
with {v.PINGS}, p as (select subsystem, list(struct_pack(f0 := f0, f1 := f1) order by f0, f1) filter (f0 > 0) as l, count(*) as pings from v_pings group by 1)
select subsystem, pings, l[len(l) // 2 + 1].f0 as f0, l[len(l) // 2 + 1].f1 as f1, l[len(l) // 2 + 1].f1 - l[len(l) // 2 + 1].f0 as bandwidth from p
""")
def band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings.bands(v.pings(spark, sf_dir))


@query(f"""
with {v.PINGS} select dataset, round(min(lat) filter (lat <> 0 or lon <> 0), 6) as south, round(max(lat) filter (lat <> 0 or lon <> 0), 6) as north,
round(min(lon) filter (lat <> 0 or lon <> 0), 6) as west, round(max(lon) filter (lat <> 0 or lon <> 0), 6) as east, round(min(time), 3) as begins, round(max(time), 3) as ends from v_pings group by 1
""")
def bounds_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pings.bounds(v.pings(spark, sf_dir), "dataset")
    return out.select("dataset", *(r(c) for c in ("south", "north", "west", "east")), r("begins", 3), r("ends", 3))


@query(f"with {v.PINGS} select distinct subsystem, channel from v_pings")
def subsystem_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.pings(spark, sf_dir).select("subsystem", "channel").distinct()


@query(f"""
with {v.PINGS} select rec_id, round(nsamples * interval_ns * 1e-9::double * 1500 / 2, 6) as slant, round(interval_ns * 1e-9::double * 750, 9) as resolution,
cast(round(nsamples * interval_ns * 1e-9::double * 750 / 0.5::double) as bigint) as bucket from v_pings where (validity & 64) <> 0 and altitude > 0 and subsystem = 20
""")
def slant_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pings.select_pings(v.pings(spark, sf_dir), 20).where(ac.altitude_valid(F.col("validity"), F.col("altitude")))
    slant = ac.slant_range_m(F.col("nsamples"), F.col("interval_ns"))
    return p.select("rec_id", r(slant, name="slant"), r(ac.resolution_m(F.col("interval_ns")), 9, "resolution"), ac.range_bucket(slant).alias("bucket"))


@query(f"""
with {v.PINGS}, a as (select rec_id, heading - 180 as d, least(abs(altitude), 1000::double) as alt from v_pings)
select rec_id, round(sign(d) * sqrt(greatest(d * d - alt * alt, 0::double)), 6) + 0 as ground, round(sign(d) * sqrt(d * d + alt * alt), 6) + 0 as slant from a
""")
def ground_and_slant_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, alt = F.col("heading") - 180, F.least(F.abs("altitude"), F.lit(1000.0))
    return v.pings(spark, sf_dir).select("rec_id", r(ac.to_ground(d, alt), name="ground"), r(ac.from_ground(d, alt), name="slant"))


@query(f"""
with {v.PINGS}, c as (select subsystem, channel, count(*) as n from v_pings group by all), k as (select subsystem, channel from c order by n desc, subsystem, channel limit 1),
g as (select time - lag(time) over (order by time, rec_id) as gap from v_pings join k using (subsystem, channel)), l as (select list(gap order by gap) as l from g where gap > 0)
select round(coalesce(l[len(l) // 2 + 1], 0.1::double), 6) as interval from l
""")
def ping_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings.ping_interval(v.pings(spark, sf_dir)).select(r("interval"))


@query("""
with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6::double as time, event_id % 4 as place, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (
    select user_id, n, event_id, time, place, time as kt, place as kp, true as kept from e where n = 1
    union all
    select e.user_id, e.n, e.event_id, e.time, e.place, case when e.place <> f.kp and e.time - f.kt >= 0.05::double then e.time else f.kt end, case when e.place <> f.kp and e.time - f.kt >= 0.05::double then e.place else f.kp end,
        e.place <> f.kp and e.time - f.kt >= 0.05::double
    from f join e on e.user_id = f.user_id and e.n = f.n + 1
)
select user_id as dataset, event_id as rec_id from f where kept
""")
def fixes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    p = e.select(F.col("user_id").alias("dataset"), F.col("event_id").alias("rec_id"), (v.micros(F.col("ts")) / 1e6).alias("time"), (F.col("event_id") % 4).cast("double").alias("lat"), F.lit(4.0).alias("lon"))
    return navigation.fix_track(p).select("dataset", "rec_id")


_SCALE = "pi() / 180 * 6378137 * (1 - e2) / ((1 - e2 * sin(radians({m})) ** 2) ** 1.5)", "pi() / 180 * 6378137 * cos(radians({m})) / sqrt(1 - e2 * sin(radians({m})) ** 2)"
_E2 = "(1 / 298.257223563::double) * (2 - 1 / 298.257223563::double)"
_N, _E = (x.replace("e2", _E2) for x in _SCALE)


def _dist(lat0: str, lon0: str, lat1: str, lon1: str) -> str:
    m = f"(({lat0} + {lat1}) / 2)"
    return f"sqrt((({lat1} - {lat0}) * {_N.format(m=m)}) ** 2 + (({lon1} - {lon0}) * {_E.format(m=m)}) ** 2)"


_TRACK = f"""{v.FIXES}, t0 as (select *, avg(lat) over (partition by dataset) as m, first(lat) over w as lat0, first(lon) over w as lon0 from v_fixes window w as (partition by dataset order by time, seq)), t1 as (select dataset, seq, time, lat, lon, (lon - lon0) * {_E.format(m='m')} as x, (lat - lat0) * {_N.format(m='m')} as y from t0),
t2 as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as step from t1 window w as (partition by dataset order by time, seq)),
t3 as (select *, sum(step) over (partition by dataset order by time, seq rows between unbounded preceding and current row) as dist from t2),
t4 as (select *, first(struct_pack(time, x, y, dist)) over (partition by dataset order by time, seq rows between 2 preceding and 2 following) as a, last(struct_pack(time, x, y, dist)) over (partition by dataset order by time, seq rows between 2 preceding and 2 following) as b from t3),
t5 as (select *, case when b.time - a.time > 1e-6 then (b.dist - a.dist) / (b.time - a.time) else 0 end as sog, degrees(atan2(b.x - a.x, b.y - a.y)) as c0 from t4), t6 as (select *, c0 - 360 * floor(c0 / 360) as course from t5),
t7 as (select *, course - lag(course) over (partition by dataset order by time, seq) as dc from t6),
v_track as (
    select dataset, seq, time, lat, lon, sog, dist, first(course) over w + sum(coalesce(dc + 180 - 360 * floor((dc + 180) / 360) - 180, 0)) over w as cog
    from t7 window w as (partition by dataset order by time, seq rows between unbounded preceding and current row)
)"""


@query(f"with {_TRACK} select dataset, seq, round(cog, 5) + 0 as cog, round(dist, 4) as dist, round(sog, 6) as sog from v_track")
def course_speed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.track(v.fixes(spark, sf_dir)).select("dataset", "seq", r("cog", 5), r("dist", 4), r("sog"))


@query(f"with {_TRACK} select dataset, seq, round(avg(cog) over (partition by dataset order by time, seq rows between 3 preceding and 3 following), 5) as smoothed from v_track")
def smoothed_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("dataset").orderBy("time", "seq")
    return navigation.track(v.fixes(spark, sf_dir)).select("dataset", "seq", r(navigation.smoothed(F.col("cog"), order, 7), 5, "smoothed"))


@query(f"""
with {v.FIXES}, p as (select dataset, time + 25::double as t, seq from v_fixes), j as (
    select p.dataset, p.seq, p.t, a.time as x0, a.lat as y0, b.time as x1, b.lat as y1 from p
    asof join v_fixes a on p.dataset = a.dataset and p.t >= a.time left join v_fixes b on b.dataset = p.dataset and b.seq = a.seq + 1
) select dataset, seq, round(case when x1 is null then y0 else y0 + (y1 - y0) * (t - x0) / (x1 - x0) end, 7) as lat_at from j
""")
def position_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.fixes(spark, sf_dir)
    probes = f.select("dataset", "seq", (F.col("time") + 25).alias("time"))
    return navigation.interpolate(f.select("dataset", "time", "lat"), probes, "time", ["lat"], "dataset").select("dataset", "seq", r("lat_at", 7))


@query(f"""
with {_TRACK}, a as (select *, avg(cog) over (partition by dataset order by seq rows between 1 preceding and 1 following) as s, count(*) over (partition by dataset) as n from v_track),
b as (select *, abs(coalesce(lead(s) over w, s) - coalesce(lag(s) over w, s)) / greatest(coalesce(lead(time) over w, time) - coalesce(lag(time) over w, time), 1e-6) as turn from a where n >= 3 window w as (partition by dataset order by seq)),
c as (select *, avg(turn) over (partition by dataset order by seq rows between 1 preceding and 1 following) < 0.02 as steady from b),
d as (select *, coalesce((steady <> lag(steady) over (partition by dataset order by seq))::int, 1) as change from c), e as (select *, sum(change) over (partition by dataset order by seq rows unbounded preceding) as run from d),
f as (select dataset, run, case when first(steady) and max(time) - min(time) >= 180 then 'line' else 'turn' end as kind, min(time) as begins, max(time) as ends, (arg_min(s, seq) + arg_max(s, seq)) / 2 as c0, max(dist) - min(dist) as length_m from e group by all),
g as (select *, case when kind = 'turn' and lag(kind) over (partition by dataset order by run) = 'turn' then 0 else 1 end as fresh from f), h as (select *, sum(fresh) over (partition by dataset order by run rows unbounded preceding) as seg from g)
select dataset, first(kind order by run) as kind, min(begins) as begins, max(ends) as ends, round(arg_min(c0 - 360 * floor(c0 / 360), run), 4) as course, round(sum(length_m), 3) as length_m from h group by dataset, seg
""")
def survey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = navigation.track(v.fixes(spark, sf_dir))
    return navigation.detect_lines(t, 0.02, 180.0, 180.0).select("dataset", "kind", "begins", "ends", r("course", 4), r("length_m", 3))


@query(f"""
with {_TRACK}, p as (select dataset, seq, time, t from (select dataset, seq, time + 25 as time from v_track), (select unnest([-3, 3]) as t)), q as (select dataset, seq, time, t, time + t as spot from p),
j as (select q.dataset, q.seq, q.t, q.spot, a.time as x0, a.cog as y0, b.time as x1, b.cog as y1 from q asof join v_track a on q.dataset = a.dataset and q.spot >= a.time left join v_track b on b.dataset = q.dataset and b.seq = a.seq + 1)
select dataset, seq, round(sum(sign(t) * case when x1 is null then y0 else y0 + (y1 - y0) * (spot - x0) / (x1 - x0) end) / 6, 6) + 0 as rate from j group by all
""")
def turn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = navigation.track(v.fixes(spark, sf_dir))
    probes = t.select("dataset", F.col("seq").alias("probe"), (F.col("time") + 25).alias("time"))
    return navigation.turn_rate_at(t, probes).select("dataset", F.col("probe").alias("seq"), r("rate"))


@query()
def towed_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.fixes(spark, sf_dir)
    xy = f.select("dataset", "seq", ((F.col("lon") - 4) * 67000).alias("x"), ((F.col("lat") - 52.5) * 111000).alias("y"))
    return navigation.pursuit(xy, 44.0, 5.0).select("dataset", "seq", r("fish_x", 4), r("fish_y", 4))


@query(f"""
with recursive {v.PINGS}, e as (select dataset, rec_id, time, subsystem as s, channel as c, row_number() over (partition by dataset order by time, rec_id) as n from v_pings),
f as (
    select dataset, n, rec_id, s, c, time, 0::bigint as row, time as began, [s * 2 + (c <> 0)::int] as held from e where n = 1
    union all
    select e.dataset, e.n, e.rec_id, e.s, e.c, e.time, f.row + (e.time - f.began > 1800 or list_contains(f.held, e.s * 2 + (e.c <> 0)::int))::int,
        case when e.time - f.began > 1800 or list_contains(f.held, e.s * 2 + (e.c <> 0)::int) then e.time else f.began end,
        case when e.time - f.began > 1800 or list_contains(f.held, e.s * 2 + (e.c <> 0)::int) then [e.s * 2 + (e.c <> 0)::int] else list_append(f.held, e.s * 2 + (e.c <> 0)::int) end
    from f join e on e.dataset = f.dataset and e.n = f.n + 1
), bands as (select distinct dataset, subsystem from v_pings), opened as (select dataset, row, arg_min(rec_id, s * 1000000000 + n) as at_id from f group by all)
select a.dataset, a.row, b.subsystem, max(f.rec_id) filter (f.c = 0) as port_id, max(f.rec_id) filter (f.c <> 0) as stbd_id, a.at_id
from opened a join bands b on a.dataset = b.dataset left join f on f.dataset = a.dataset and f.row = a.row and f.s = b.subsystem group by a.dataset, a.row, b.subsystem, a.at_id
""")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.pair_bands(v.pings(spark, sf_dir), 2400.0)


@query(f"""
with {v.PINGS}, q as (select unnest([0, 1, 2]) as probe), p as (select probe, 1.0::double * ((select min(time) from v_pings) + probe * 86400.5::double) as want from q),
x as (select probe, rec_id, row_number() over (partition by probe order by abs(time - want), rec_id) as n from v_pings, p) select probe, rec_id as row from x where n = 1
""")
def row_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.pings(spark, sf_dir)
    start = p.agg(F.min("time").alias("t0"))
    probes = spark.range(3).select(F.col("id").cast("int").alias("probe")).join(F.broadcast(start)).select("probe", (F.col("t0") + F.col("probe") * 86400.5).alias("at"))
    return rows.nearest_in_time(p.select(F.col("rec_id").alias("row"), "time"), probes)


@query(f"""
with {v.PINGS}, b as (select dataset, subsystem, max((f0 + f1) / 2) filter (f0 > 0) as recorded from v_pings group by 1, 2),
o as (select p_partkey % 100 as dataset, p_partkey as place, 300000 + (p_partkey * 7919 % 2000000)::double as hz from part),
m as (select b.dataset, subsystem, recorded, place, round((hz - recorded) / 655360) as turns from b join o on b.dataset = o.dataset and recorded > 0 and hz >= recorded - 25000 and abs(hz - recorded - round((hz - recorded) / 655360) * 655360) <= 25000),
f as (select dataset, subsystem, arg_min(turns, place) as turns from m group by 1, 2)
select b.dataset, b.subsystem, recorded, recorded + coalesce(turns, 0) * 655360::double as centre from b left join f using (dataset, subsystem)
""")
def recovered_band_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.pings(spark, sf_dir)
    b = p.groupBy("dataset", "subsystem").agg(F.max(F.when(F.col("f0") > 0, (F.col("f0") + F.col("f1")) / 2)).alias("recorded"))
    k = F.col("p_partkey")
    o = v.table(spark, sf_dir, "part").select((k % 100).alias("dataset"), k.alias("place"), (300000 + (k * 7919 % 2000000)).cast("double").alias("hz"))
    return pings.recover_band_centres(b, o, "dataset")


@query("""
with l as (select l_returnflag as side, list(l_extendedprice order by l_extendedprice) as s, quantile_cont(l_extendedprice, 0.6) as p60, quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, [0.01, 0.99]) as cut from lineitem group by 1)
select side, round(p60, 6) as p60, round(median, 6) as median, s[len(s) // 2 + 1] as upper_median, round(cut[1], 6) as low, round(cut[2], 6) as high from l
""")
def quantile_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = v.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), "l_extendedprice")
    wanted, rule = {"p60": 0.6, "median": 0.5, "upper_median": 0.5, "low": 0.01, "high": 0.99}, dict.fromkeys(("p60", "median", "low", "high"), "linear") | {"upper_median": "upper"}
    p = quantiles(rows_, "l_extendedprice", wanted, "side", rule=rule)
    return p.select("side", r("p60"), r("median"), "upper_median", r("low"), r("high"))


@query("""
with c as (select quantile_cont(amp, 0.01) as lo, quantile_cont(amp, 0.99) as hi from (select l_extendedprice as amp from lineitem where l_extendedprice > 0))
select l_orderkey, l_linenumber, cast(round(least(greatest((l_extendedprice - lo) / greatest(hi - lo, 1e-9::double), 0), 1) ** 0.8::double * 255) as integer) as grey from lineitem, c
""")
def stretched_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amp"))
    cut = quantiles(rows_.where("amp > 0"), "amp", {"low": 0.01, "high": 0.99})
    return rows_.join(F.broadcast(cut)).select("l_orderkey", "l_linenumber", ac.stretch(F.col("amp"), F.col("low"), F.col("high"), 0.8).alias("grey"))


@query(f"""
with {v.TRACES} select rec_id, list_transform(range(len(data)), lambda i: round((data[greatest(i - 2, 0) + 1] + data[greatest(i - 1, 0) + 1] + data[i + 1] + data[least(i + 1, len(data) - 1) + 1] + data[least(i + 2, len(data) - 1) + 1]) / 5, 6)) as smooth from v_traces
""")
def smoothed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.traces(spark, sf_dir).select("rec_id", F.transform(ar.smooth_clamped(F.col("data"), 5), lambda x: F.round(x, 6)).alias("smooth"))


@query(f"""
with {v.TRACES}, g as (select rec_id, data, sqrt(((len(data) - 1) ** 2)::double - 64) as reach, len(data) as n from v_traces),
x as (select rec_id, data, n, list_transform(range(32), lambda i: least(sqrt((i * reach / 31) ** 2 + 64), (n - 1)::double)) as xs from g)
select rec_id, list_transform(xs, lambda x: round(data[cast(floor(x) as integer) + 1] + (coalesce(data[cast(floor(x) as integer) + 2], data[cast(floor(x) as integer) + 1]) - data[cast(floor(x) as integer) + 1]) * (x - floor(x)), 5)) as ground from x
""")
def ground_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.traces(spark, sf_dir).select("rec_id", F.transform(ar.slant_to_ground(F.col("data"), F.lit(8.0), 32), lambda x: F.round(x, 5)).alias("ground"))


@query(f"""with {v.TRACES} select rec_id, list_transform(range(len(data) // 5), lambda i: round(list_sum(data[i * 5 + 1:i * 5 + 5]) / 5, 6)) as binned from v_traces""")
def binned_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.traces(spark, sf_dir).select("rec_id", F.transform(ar.bin_columns(F.col("data"), 5), lambda x: F.round(x, 6)).alias("binned"))


@query(f"""
with {v.TRACES}, c as (select rec_id, setting, unnest(data) as x, unnest(range(len(data))) as col from v_traces)
select setting, col as col, round(quantile_cont(x, 0.5), 6) as level from c group by all
""")
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.traces(spark, sf_dir).select("setting", F.posexplode("data").alias("col", "x"))
    return c.groupBy("setting", F.col("col").cast("long").alias("col")).agg(r(F.percentile("x", F.lit(0.5)), name="level"))


@query(f"""
with {v.TRACES}, c as (select rec_id, unnest(data) as x, unnest(range(len(data))) as i from v_traces), b as (select cast(floor(degrees(atan2(i * 0.5::double, 8::double))) as bigint) as bin, x from c where x > 0)
select bin, count(*) as n, round(quantile_cont(x, 0.5), 6) as level from b group by 1 having count(*) >= 20
""")
def angle_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.traces(spark, sf_dir).select(F.posexplode("data").alias("i", "x")).where("x > 0")
    theta = F.degrees(F.atan2(F.col("i") * 0.5, F.lit(8.0)))
    return c.groupBy(F.floor(theta).alias("bin")).agg(F.count("*").alias("n"), r(F.percentile("x", F.lit(0.5)), name="level")).where("n >= 20")


_PRI = """greatest(case when theta <= 12 then 0 when theta < 22 then (theta - 12) * 0.30 / 10 when theta < 35 then 0.30 + (theta - 22) * 0.50 / 13 when theta < 50 then 0.80 + (theta - 35) * 0.20 / 15
    when theta < 65 then 1 when theta < 75 then 1 - (theta - 65) * 0.15 / 10 when theta < 82 then 0.85 - (theta - 75) * 0.30 / 7 when theta < 90 then 0.55 - (theta - 82) * 0.25 / 8 else 0.30 end::double, 0.04::double) ** 8"""
_CELLS = f"{v.SAMPLES}, v_cells as (select gx, gy, sum(amp * {_PRI}) / sum({_PRI}) as value, least(count(*), 255) as cover from v_samples group by all)"


@query(f"with {_CELLS} select gx, gy, round(value, 4) as value, cover from v_cells")
def mosaic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("gx", "gy", r("value", 4), "cover")


def _cells(spark: SparkSession, sf_dir: str, db: bool = False) -> DataFrame:
    s = v.samples(spark, sf_dir).withColumn("pri", mosaic.priority(F.col("theta")))
    return mosaic.finish(mosaic.accumulate(s), db)


@query(f"with {_CELLS} select gx, gy, round(20 * log10(greatest(value, 1e-6::double)), 5) as value, cover from v_cells")
def mosaic_decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, True).select("gx", "gy", r("value", 5), "cover")


@query(f"with {_CELLS} select gx // 4 as gx, gy // 4 as gy, round(avg(value), 4) as value, max(cover) as cover from v_cells group by all")
def mosaic_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.tile(_cells(spark, sf_dir), 2).select("gx", "gy", r("value", 4), "cover")


@query(f"""
with {_CELLS}, s as (
    select a.gx, a.gy, a.value, avg(b.value) as m, greatest(avg(b.value * b.value) - avg(b.value) ** 2, 0) as v from v_cells a join v_cells b on abs(a.gx - b.gx) <= 2 and abs(a.gy - b.gy) <= 2 group by a.gx, a.gy, a.value
), c as (select quantile_cont(sqrt(v) / m, 0.1) as cu from s where m > 0 and v > 0)
select gx, gy, round(m + case when v > 0 then least(greatest(1 - cu * cu * m * m / v, 0), 1) else 0 end * (value - m), 2) as value from s, c
""")
def despeckled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.despeckle(_cells(spark, sf_dir)).select("gx", "gy", r("value", 2))


_STOPS = """(values
    ('grey', 0.00, 16, 16, 18), ('grey', 1.00, 244, 246, 248), ('depth', 0.00, 8, 20, 60), ('depth', 0.20, 12, 56, 120), ('depth', 0.40, 22, 104, 168), ('depth', 0.60, 64, 158, 190), ('depth', 0.80, 140, 205, 205), ('depth', 1.00, 222, 240, 226),
    ('terrain', 0.00, 22, 60, 100), ('terrain', 0.35, 70, 140, 170), ('terrain', 0.50, 214, 214, 170), ('terrain', 0.65, 120, 160, 90), ('terrain', 0.85, 150, 120, 80), ('terrain', 1.00, 250, 250, 250),
    ('viridis', 0.00, 68, 1, 84), ('viridis', 0.25, 59, 82, 139), ('viridis', 0.50, 33, 145, 140), ('viridis', 0.75, 94, 201, 98), ('viridis', 1.00, 253, 231, 37),
    ('magma', 0.00, 0, 0, 4), ('magma', 0.25, 81, 18, 124), ('magma', 0.50, 183, 55, 121), ('magma', 0.75, 252, 137, 97), ('magma', 1.00, 252, 253, 191),
    ('turbo', 0.00, 48, 18, 59), ('turbo', 0.20, 40, 130, 220), ('turbo', 0.40, 50, 200, 160), ('turbo', 0.60, 180, 222, 44), ('turbo', 0.80, 250, 140, 40), ('turbo', 1.00, 122, 4, 3),
    ('ice', 0.00, 8, 12, 30), ('ice', 0.50, 58, 118, 158), ('ice', 1.00, 232, 246, 252), ('amber', 0.00, 12, 8, 4), ('amber', 0.50, 168, 96, 26), ('amber', 1.00, 255, 236, 190)
) t(ramp, stop, r, g, b)"""


@query(f"""
with stops as (select ramp, stop::double as s0, r as r0, g as g0, b as b0, lead(stop::double) over w as s1, lead(r) over w as r1, lead(g) over w as g1, lead(b) over w as b1 from {_STOPS} window w as (partition by ramp order by stop)),
shares as (select grey, least(greatest((grey - 17) / 206::double, 0), 1) as t from (select distinct p_partkey % 256 as grey from part))
select ramp, cast(grey as integer) as grey, cast(round(r0 + (r1 - r0) * (t - s0) / (s1 - s0)) as integer) as r, cast(round(g0 + (g1 - g0) * (t - s0) / (s1 - s0)) as integer) as g, cast(round(b0 + (b1 - b0) * (t - s0) / (s1 - s0)) as integer) as b
from shares join stops on s1 is not null and (t > s0 or t = 0 and s0 = 0) and t <= s1
""")
def colour_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = v.table(spark, sf_dir, "part").select((F.col("p_partkey") % 256).cast("int").alias("grey")).distinct()
    ramps = F.explode(F.array(*(F.struct(F.lit(n).alias("ramp"), mosaic.styled(F.col("grey"), 17, 223, ramp=n).alias("c")) for n in mosaic.RAMPS)))
    return grey.select("grey", ramps.alias("x")).select("x.ramp", "grey", "x.c.r", "x.c.g", "x.c.b")


@query("""
with o as (select o_custkey as dataset, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as stroke, o_totalprice as level from orders),
w as (select *, list(level) filter (level > 0) over (partition by dataset order by stroke rows between 20 preceding and 20 following) as near from o), m as (select *, list_sort(near)[len(near) // 2 + 1] as med from w),
g as (select *, case when len(near) >= 5 then (med / level) ** 0.5::double end as g from m)
select dataset, stroke, round(case when g between 0.25 and 4 then g else 1 end, 6) as gain from g
""")
def along_track_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    levels = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.row_number().over(order).cast("long").alias("stroke"), F.col("o_totalprice").alias("level"))
    return mosaic.equalise(levels, 0.5).select("dataset", "stroke", r("gain"))


@query(f"""
with {v.FIXES}, s as (select dataset, seq, lat, lon, lag(lat) over w as pl, lag(lon) over w as po from v_fixes window w as (partition by dataset order by seq))
select dataset, count(*) as points, round(coalesce(sum({_dist('pl', 'po', 'lat', 'lon')}), 0), 3) as length_m from s group by 1
""")
def track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("dataset").orderBy("seq")
    step = geo.distance_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return v.fixes(spark, sf_dir).withColumn("step", step).groupBy("dataset").agg(F.count("*").alias("points"), r(F.coalesce(F.sum("step"), F.lit(0.0)), 3, "length_m"))


@query(f"""
with {v.FIXES} select dataset, seq, round(2 * 6371008.8::double * asin(least(sqrt(sin(radians(lat - 52.4) / 2) ** 2 + cos(radians(52.4)) * cos(radians(lat)) * sin(radians(lon - 3.9) / 2) ** 2), 1)), 4) as metres,
round((degrees(atan2(sin(radians(lon - 3.9)) * cos(radians(lat)), cos(radians(52.4)) * sin(radians(lat)) - sin(radians(52.4)) * cos(radians(lat)) * cos(radians(lon - 3.9)))) + 360) % 360, 5) as bearing,
cast(floor((lon + 180) / 6) + 1 as integer) as zone, round((lon + 180) / 360 * 67108864, 4) as px, round((0.5::double - atanh(sin(radians(lat))) / (2 * pi())) * 67108864, 4) as py from v_fixes
""")
def geodesy_of_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    px, py = geo.lonlat_to_px(lon, lat, 18)
    f = v.fixes(spark, sf_dir)
    return f.select("dataset", "seq", r(geo.haversine_m(F.lit(52.4), F.lit(3.9), lat, lon), 4, "metres"), r(geo.initial_bearing(F.lit(52.4), F.lit(3.9), lat, lon), 5, "bearing"), geo.utm_zone(lon).alias("zone"), r(px, 4, "px"), r(py, 4, "py"))


@query()
def projected_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.fixes(spark, sf_dir)
    for epsg in (3857, 32631, 25831, 28992, 3035, 23031):
        out = geo.with_projected(out, epsg, "lat", "lon", f"x{epsg}", f"y{epsg}")
    return out.select("dataset", "seq", *(r(c, 4) for c in out.columns if c[0] in "xy"))


@query(f"""
with {v.TARGETS}, az as (select unnest(range(10)) * 10::double as azimuth), u as (select azimuth, radius, x * cos(radians(azimuth)) - y * sin(radians(azimuth)) as u, x * sin(radians(azimuth)) + y * cos(radians(azimuth)) as w from v_targets, az),
b as (select azimuth, min(u - radius) - 80 as u0, max(u + radius) + 80 as u1, min(w - radius) - 80 as v0, max(w + radius) + 80 as v1 from u group by 1), n as (select *, greatest(ceil((u1 - u0) / 67) + 1, 2) as k from b)
select azimuth, cast(k + 2 as bigint) as lines, round((u1 - u0) / (k - 1), 5) as gap, round(v1 - v0, 5) as length from n
""")
def plan_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = planner.plan_boxes(v.targets(spark, sf_dir), planner.azimuth_steps(spark), planner.Sonar())
    return boxes.select("azimuth", F.col("lines").cast("long").alias("lines"), r("gap", 5), r(F.col("v1") - F.col("v0"), 5, "length"))


_PLAN = f"""{v.TARGETS}, az as (select unnest(range(10)) * 10::double as azimuth),
p_u as (select azimuth, target, radius, x * cos(radians(azimuth)) - y * sin(radians(azimuth)) as u, x * sin(radians(azimuth)) + y * cos(radians(azimuth)) as w from v_targets, az),
p_box as (select azimuth, min(u - radius) - 80 as u0, max(u + radius) + 80 as u1, min(w - radius) - 80 as v0, max(w + radius) + 80 as v1 from p_u group by 1),
p_n as (select *, greatest(cast(ceil((u1 - u0) / 67) as bigint) + 1, 2) as k, greatest(u1 - u0, 67) as span from p_box),
p_lines as (select azimuth, v0, v1, unnest(range(k + 2)) as line, k, span, (u0 + u1) / 2 - span / 2 as x0 from p_n),
v_lines as (select azimuth, v0, v1, line, x0 + (line - 1) * span / (k - 1) as u from p_lines)"""


@query(f"""
with {_PLAN}, s as (select azimuth, unnest(range(1400)) as i, u0, u1 from p_box), c as (select s.azimuth, i, count(*) filter (abs(u0 + i * (u1 - u0) / 1399 - u) between 8 and 75) as looks from s join v_lines using (azimuth) group by all)
select azimuth, round(avg((looks = 0)::double), 5) as none, round(avg((looks >= 1)::double), 5) as once, round(avg((looks >= 2)::double), 5) as twice, min(looks) as worst from c group by 1
""")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = planner.plan_boxes(v.targets(spark, sf_dir), planner.azimuth_steps(spark), planner.Sonar())
    return planner.coverage(boxes, planner.plan_lines(boxes), planner.Sonar()).select("azimuth", *(r(c, 5) for c in ("none", "once", "twice")), "worst")


@query(f"""
with {_PLAN}, s as (select azimuth, target, u as middle, radius, unnest(range(21)) as i from p_u), d as (select s.azimuth, target, i, v_lines.u - (middle - radius + 2 * radius * i / 20) as d, abs(v_lines.u - middle) as near from s join v_lines using (azimuth)),
c as (select azimuth, target, i, count(*) filter (abs(d) between 8 and 75) as looks, count(*) filter (abs(d) between 11.25 and 67.5) as good, count(*) filter (abs(d) between 8 and 75 and d > 0) as pos, min(near) as near from d group by all),
w as (select azimuth, target, min(looks) as looks, min(good) as good, bool_and(pos > 0 and pos < looks) as both, min(near) as near from c group by all)
select azimuth, target, looks, good, "both" as both_sides, round(near, 5) as nearest, case when looks = 0 then 'missed' when looks >= 2 and "both" and good >= 1 then 'good' else 'thin' end as verdict from w
""")
def plan_target_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, azimuths = v.targets(spark, sf_dir), planner.azimuth_steps(spark)
    lines = planner.plan_lines(planner.plan_boxes(targets, azimuths, planner.Sonar()))
    return planner.target_looks(targets, azimuths, lines, planner.Sonar()).select("azimuth", "target", "looks", "good", F.col("both").alias("both_sides"), r("nearest", 5), "verdict")


@query(f"""
with {_PLAN}, r as (select *, row_number() over (partition by azimuth order by line) as run from v_lines), d as (select *, case when run % 2 = 1 then 1 else -1 end as dir from r)
select azimuth, line, run, round(u, 5) as u, dir::double as dir, round(case when dir > 0 then v0 - 150 else v1 + 150 end, 5) as starts, round(case when dir > 0 then v0 + 54 else v1 - 54 end, 5) as on_m,
round(case when dir > 0 then v1 + 54 else v0 - 54 end, 5) as off_m, round(case when dir > 0 then v1 + 60 else v0 - 60 end, 5) as ends, case when dir > 0 then azimuth else azimuth + 180 end as heading, round(v1 - v0 + 210, 5) as length from d
""")
def plan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = planner.plan_boxes(v.targets(spark, sf_dir), planner.azimuth_steps(spark), planner.Sonar())
    runs = planner.plan_runs(planner.plan_lines(boxes, spread=False))
    return runs.select("azimuth", "line", F.col("run").cast("long").alias("run"), r("u", 5), "dir", r("starts", 5), r("on", 5, "on_m"), r("off", 5, "off_m"), r("ends", 5), "heading", r("length", 5))


@query(f"""
with {_PLAN}, wide as (select azimuth, u0, u1, cast(ceil((u1 - u0) / 150) as bigint) + 1 as k, (u0 + u1) / 2 as mid, greatest(u1 - u0, 150) as span from p_box),
l as (select azimuth, k, mid, span, unnest(range(greatest(k, 2))) as line from wide), lines as (select azimuth, mid - span / 2 + line * span / (greatest(k, 2) - 1) as u from l),
s as (select azimuth, unnest(range(500)) as i, u0, u1 from wide), c as (select s.azimuth, i, u0 + i * (u1 - u0) / 499 as spot, u1, (u1 - u0) / 499 as step, count(*) filter (abs(u0 + i * (u1 - u0) / 499 - u) between 8 and 75) as looks from s join lines using (azimuth) group by all),
g as (select *, i - row_number() over (partition by azimuth order by i) as island from c where looks = 0)
select azimuth, round(min(spot), 5) as u_from, round(least(max(spot) + max(step), max(u1)), 5) as u_to from g group by azimuth, island
""")
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sonar = planner.Sonar(mode="custom", spacing_m=150.0)
    boxes = planner.plan_boxes(v.targets(spark, sf_dir), planner.azimuth_steps(spark), sonar)
    return planner.gaps(boxes, planner.plan_lines(boxes), sonar).select("azimuth", r("u_from", 5), r("u_to", 5))


@query()
def plan_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planner.quadrant(v.targets(spark, sf_dir), planner.azimuth_steps(spark))
    return plans.select("azimuth", "lines", "verdict", "worst", "teardrops", *(r(c, 5) for c in ("gap", "line_m", "turn_m", "metres", "seconds", "none", "once", "twice")))


_CLASSES = """(values
    (1, 'cleared', '#78889a', ['nombo', 'non mine', 'nonmine', 'not a mine', 'no contact', 'nothing', 'cleared', 'clear', 'false', 'discounted', 'rejected', 'noise', 'artefact']),
    (2, 'suspect', '#ff7a1a', ['mine like', 'minelike', 'milco', 'milec', 'mine echo', 'suspect', 'suspected', 'possible', 'probable', 'contact of interest', 'poi', 'unknown']),
    (3, 'ordnance', '#ff3b30', ['mine', 'uxo', 'ordnance', 'munition', 'shell', 'bomb', 'torpedo', 'depth charge', 'explosive', 'eod', 'projectile']),
    (4, 'wreck', '#c77dff', ['wreck', 'hull', 'vessel', 'aircraft', 'plane', 'barge', 'boat']),
    (5, 'utility', '#3ec8ff', ['pipe', 'pipeline', 'cable', 'chain', 'rope', 'net', 'netting', 'mooring', 'anchor', 'umbilical', 'wire']),
    (6, 'debris', '#f0b429', ['debris', 'scrap', 'junk', 'rubbish', 'litter', 'tyre', 'tire', 'drum', 'container', 'trolley', 'metal', 'object']),
    (7, 'geology', '#9fb0bf', ['boulder', 'rock', 'rocky', 'stone', 'outcrop', 'reef', 'cobble']),
    (8, 'seabed', '#b3814d', ['scour', 'sand', 'sandwave', 'sand wave', 'ripple', 'sediment', 'mud', 'clay', 'gravel', 'trawl', 'trawl mark', 'depression', 'pockmark', 'dredge', 'seabed feature', 'feature']),
    (9, 'biology', '#5fd38d', ['weed', 'seaweed', 'kelp', 'vegetation', 'fish', 'shoal', 'coral', 'biological', 'biology']),
    (10, 'area', '#7aa7ff', ['area', 'area of interest', 'aoi', 'box', 'zone', 'datum', 'search'])
) t(place, name, colour, words)"""
_CALLED = ["Wrecks", "anchor-chain", "Sand waves", "boulders", "mine-like (MILCO)", "NOMBO", "Mines", "magnetic anomaly", "Netting", "fish shoals", "glass", "Non-mine", "tyres", "lost gear", "", "AOI"]
_CALLED_SQL = f"list_extract({_CALLED!r}, cast(p_partkey % {len(_CALLED)} + 1 as integer))"


@query(f"""
with n as (select p_partkey, trim(regexp_replace(lower({_CALLED_SQL}), '[^a-z0-9]+', ' ', 'g')) as t from part),
w as (select place, name, colour, unnest(words) as word from {_CLASSES}), d as (select distinct t from n),
m as (select t, place, name, colour from d join w on case when contains(word, ' ') then contains(t, word) else len(list_filter(string_split(t, ' '), lambda x: case when len(x) > 3 and x like '%s' then x[:-2] else x end = case when len(word) > 3 and word like '%s' then word[:-2] else word end)) > 0 end),
g as (select t, arg_min(name, place) as name, arg_min(colour, place) as colour from m group by t),
h as (select t, list_reduce(list_concat([2166136261::ubigint], list_transform(string_split(t, ''), lambda c: ascii(c)::ubigint)), lambda a, b: (xor(a, b) * 16777619::ubigint) % 4294967296::ubigint) as h from d where t <> '')
select p_partkey, name as class_group, coalesce(colour, case when t = '' then '#f0b429' else list_extract(['#4fa3e8', '#8f7ae0', '#35b8a6', '#7cc45a', '#c9a227', '#5ec8c0'], cast(h % 6 + 1 as integer)) end) as colour from n left join g using (t) left join h using (t)
""")
def contact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = F.element_at(F.array(*map(F.lit, _CALLED)), (F.col("p_partkey") % len(_CALLED) + 1).cast("int"))
    return v.table(spark, sf_dir, "part").select("p_partkey", contacts.class_group(called).alias("class_group"), contacts.class_colour(called).alias("colour"))


@query("select c_custkey, case when epoch_ms(t) % 1000 = 0 then strftime(t, '%Y-%m-%dT%H:%M:%SZ') else strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') end as iso, h from (select c_custkey, make_timestamp(1700000000000000 + c_custkey * 1250000) as t, (c_custkey * 37 // 3600) || ':' || lpad(((c_custkey * 37 // 60) % 60)::varchar, 2, '0') || ':' || lpad((c_custkey * 37 % 60)::varchar, 2, '0') as h from customer)")
def formatted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return v.table(spark, sf_dir, "customer").select("c_custkey", contacts.iso8601(1700000000 + k * 1.25).alias("iso"), contacts.hms(k * 37).alias("h"))


@query("select n_name as name, 'own' as origin from nation where n_regionkey < 3 union all select n_name, 'pool' from nation where n_regionkey >= 2 and n_name not in (select n_name from nation where n_regionkey < 3)")
def own_and_pool_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.table(spark, sf_dir, "nation")
    named = lambda cond, origin: n.where(cond).select(F.col("n_name").alias("name"), F.lit(origin).alias("origin"))
    return contacts.own_or_pool(named("n_regionkey < 3", "own"), named("n_regionkey >= 2", "pool"))


@query("""
with c as (select l_partkey % 64 as gx, l_suppkey % 64 as gy, avg(l_extendedprice) as value from lineitem group by all), s as (select min(value) as lo, max(value) as hi from c)
select gx, gy, cast(round((value - lo) / (hi - lo) * 65534) as integer) as code from c, s
""")
def imported_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = v.samples(spark, sf_dir).groupBy("gx", "gy").agg(F.avg("amp").alias("value"))
    span = cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return cells.join(F.broadcast(span)).select("gx", "gy", ac.quantise(F.col("value"), F.col("lo"), F.col("hi")).alias("code"))


@query(f"with {v.FIXES} select dataset, seq from v_fixes where seq % 3 = 0")
def decimated_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = v.fixes(spark, sf_dir).withColumnRenamed("seq", "was")
    return pings.every_nth(rows_, F.col("was"), 3, "dataset").select("dataset", F.col("seq").cast("long").alias("seq"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, replace(replace(replace(event_type, ' ', '_'), '/', '_'), '.', '_') || '____' || user_id || '_' as name from events")
def json_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), contacts.safe_name(F.concat("event_type", F.lit(" /.."), "user_id", F.lit("é"))).alias("name"))


@query("""
with b as (select s_suppkey, 3.9::double + (s_suppkey % 50) * 0.01::double as w, 52.4::double + (s_suppkey % 40) * 0.01::double as s from supplier),
t as (select s_suppkey, cast(floor((w + 180) / 360 * 16384) as bigint) as x0, cast(floor((w + 0.05::double + 180) / 360 * 16384) as bigint) as x1, cast(floor((0.5::double - atanh(sin(radians(s + 0.03::double))) / (2 * pi())) * 16384) as bigint) as y0, cast(floor((0.5::double - atanh(sin(radians(s))) / (2 * pi())) * 16384) as bigint) as y1 from b),
x as (select s_suppkey, unnest(range(x0, x1 + 1)) as x, y0, y1 from t) select s_suppkey, x, unnest(range(y0, y1 + 1)) as y from x
""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    w, s = 3.9 + (k % 50) * 0.01, 52.4 + (k % 40) * 0.01
    return v.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(geo.tiles_for(w, s, w + 0.05, s + 0.03, 14)).alias("t")).select("s_suppkey", "t.x", "t.y")


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace as the port side of a row and, turned about, as its starboard side; the label is the recording."""
    t = v.traces(spark, sf_dir)
    k = F.col("rec_id")
    return t.select(
        F.col("setting").cast("long").alias("dataset"), k.alias("row"), "data", F.reverse("data").alias("stbd"), F.when(k % 5 != 0, 4.0 + k % 3).alias("altitude_m"), (0.4 + (k % 2) * 0.1).alias("resolution_m"),
        (k * 0.5).alias("x"), (k % 10 * 0.1).alias("y"), (k % 360).cast("double").alias("bearing"),
    ).withColumnRenamed("data", "port")


@query()
def gain_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 4)).alias(c)
    return waterfall.gain_model(_image_rows(spark, sf_dir), 32).select("bucket", "pings", r("half_width_m", 4), rounded("port_profile"), rounded("stbd_profile"), r("reference", 4), r("low", 4), r("high", 4))


@query()
def waterfall_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _image_rows(spark, sf_dir)
    return waterfall.render(lines, waterfall.gain_model(lines, 64), 64).select("dataset", "row", r("half_width_m", 4), r("altitude", 4), F.hex("pixels").alias("pixels"))


@query()
def painted_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = waterfall.strokes(_image_rows(spark, sf_dir), 64)
    return mosaic.finish(mosaic.accumulate(mosaic.splat_line(laid))).select("gx", "gy", r("value", 3), "cover")


@query()
def mosaic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = waterfall.with_priors(_image_rows(spark, sf_dir)).withColumn("usable", F.col("row") % 7 != 0)
    return mosaic.build(lines, 64).select("gx", "gy", r("value", 3), "grey", "cover")


@query("""
with t as (select label as dataset, vec_id as row, case when vec_id % 5 <> 0 then (4 + vec_id % 3) / (0.4 + (vec_id % 2) * 0.1::double) end as raw, row_number() over (partition by label order by vec_id) - 1 as n, count(*) over (partition by label) - 1 as last from embeddings),
f as (select *, coalesce(last_value(raw ignore nulls) over (partition by dataset order by n rows unbounded preceding), first_value(raw ignore nulls) over (partition by dataset order by n rows between unbounded preceding and unbounded following)) as filled from t),
o as (select f.dataset, f.row, f.raw, f.n, f.last, unnest(range(-4, 5)) as d from f), v as (select o.dataset, o.row, o.raw, g.filled from o join f g on g.dataset = o.dataset and g.n = least(greatest(o.n + o.d, 0), o.last))
select dataset::bigint as dataset, row, round(case when raw is null then 0 else quantile_cont(filled, 0.5) end, 6) as prior from v group by dataset, row, raw
""")
def steady_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waterfall.with_priors(_image_rows(spark, sf_dir)).select("dataset", "row", r("prior"))
