"""Queries of plans as they leave the engine, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.operators import plan_export, planner
from seabright.plans import views as v
from seabright.plans.survey_views import _PLAN, query, r

SONAR, RIG = planner.Sonar(mode="custom", spacing_m=150.0), planner.Rig(run_out_m=10.0)

_WIDE = f"""{_PLAN}, w_box as (select *, greatest(cast(ceil((u1 - u0) / 150) as bigint) + 1, 2) as k, greatest(u1 - u0, 150) as span from p_box),
w_lines as (select azimuth, u0, u1, v0, v1, line, (u0 + u1) / 2 - span / 2 + line * span / (k - 1) as u from (select *, unnest(range(k)) as line from w_box)),
w_runs as (select *, case when row_number() over (partition by azimuth order by line) % 2 = 1 then 1 else -1 end as dir from w_lines)"""


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, lines and runs of a plan that leaves gaps and stops short."""
    boxes = planner.plan_boxes(v.targets(spark, sf_dir), planner.azimuth_steps(spark), SONAR)
    lines = planner.plan_lines(boxes, RIG, spread=False)
    return boxes, lines, planner.plan_runs(lines, RIG)


@query(f"""
with {_WIDE}, ends as (select *, case when dir > 0 then v0 else v1 end as enter, case when dir > 0 then v1 else v0 end as leave from w_runs),
unseen as (select azimuth from (select b.azimuth, i, count(*) filter (abs(b.u0 + i * ((b.u1 - b.u0) / 1399) - l.u) between 8 and 75) as looks from w_box b, (select unnest(range(1400)) as i) join w_lines l on l.azimuth = b.azimuth group by 1, 2) group by 1 having min(looks) = 0),
samples as (select b.azimuth, i, b.u0 + i * ((b.u1 - b.u0) / 499) as spot, b.u1, (b.u1 - b.u0) / 499 as step, b.v0, b.v1, count(*) filter (abs(b.u0 + i * ((b.u1 - b.u0) / 499) - l.u) between 8 and 75) as looks
    from w_box b, (select unnest(range(500)) as i) join w_lines l on l.azimuth = b.azimuth where b.azimuth in (select azimuth from unseen) group by all),
islands as (select azimuth, v0, v1, min(spot) as a, least(max(spot) + max(step), max(u1)) as b from (select *, i - row_number() over (partition by azimuth order by i) as island from samples where looks = 0) group by azimuth, v0, v1, island),
bands as (
    select azimuth, 'cover' as kind, v0, v1, greatest(u + 8, u0) as a, least(u + 75, u1) as b from w_lines union all select azimuth, 'cover', v0, v1, greatest(u - 75, u0), least(u - 8, u1) from w_lines
    union all select azimuth, 'gap', v0, v1, a, b from islands union all select azimuth, 'box', v0, v1, u0, u1 from w_box
), rings as (select azimuth, kind, null as name, null as heading, unnest([{{'k': 0, 'v': v0, 'u': a}}, {{'k': 1, 'v': v0, 'u': b}}, {{'k': 2, 'v': v1, 'u': b}}, {{'k': 3, 'v': v1, 'u': a}}, {{'k': 4, 'v': v0, 'u': a}}]) as p, a from bands where b - a >= 0.01),
legs as (
    select azimuth, line, u, dir, 'runin' as kind, enter - dir * 150 as a, enter as b from ends union all select azimuth, line, u, dir, 'line', enter, leave - dir * 44 from ends
    union all select azimuth, line, u, dir, 'short', leave - dir * 44, leave from ends union all select azimuth, line, u, dir, 'runout', leave, leave + dir * 10 from ends
), strips as (
    select azimuth, kind, 'L' || lpad(cast(line + 1 as varchar), 2, '0') as name, case when kind = 'line' then case when dir > 0 then azimuth else azimuth + 180 end end as heading,
        unnest([{{'k': 0, 'v': a, 'u': u}}, {{'k': 1, 'v': b, 'u': u}}]) as p from legs where (b - a) * dir > 0.5
), every as (select azimuth, kind, name, heading, p from rings union all select * from strips)
select azimuth, kind, name, heading, p.k as k, round(p.v, 5) + 0 as v, round(p.u, 5) + 0 as u,
    round(52.5::double + (p.v * cos(radians(azimuth)) - p.u * sin(radians(azimuth))) / m.north, 7) as lat, round(4::double + (p.u * cos(radians(azimuth)) + p.v * sin(radians(azimuth))) / m.east, 7) as lon
from every, (select pi() / 180 * 6378137::double * (1 - e2) / (w * sqrt(w)) as north, pi() / 180 * 6378137::double * cos(radians(52.5)) / sqrt(w) as east
    from (select e2, 1 - e2 * sin(radians(52.5)) ** 2 as w from (select 2 / 298.257223563::double - (1 / 298.257223563::double) ** 2 as e2))) m
""")
def plan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corner of every shape but the turns, which SQL has no words for (see ``plan_turn_ways``)."""
    boxes, lines, runs = _plans(spark, sf_dir)
    shapes = plan_export.plan_shapes(boxes, lines, runs, planner.plan_turns(runs, RIG), SONAR, RIG).where("kind <> 'turn'")
    corners = shapes.select("azimuth", "kind", "name", "heading", F.posexplode("points").alias("k", "p")).select("azimuth", "kind", "name", "heading", "k", "p.u", "p.v")
    lat, lon = plan_export.placed(F.col("u"), F.col("v"), F.col("azimuth"), 52.5, 4.0)
    return corners.select("azimuth", "kind", "name", "heading", "k", r("v", 5), r("u", 5), r(lat, 7, "lat"), r(lon, 7, "lon"))


@query(f"""
with {_PLAN}, n as (select *, case when row_number() over (partition by azimuth order by line) % 2 = 1 then 1 else -1 end as dir from v_lines),
e as (select azimuth, line, u, dir, case when dir > 0 then v0 else v1 end as enter, case when dir > 0 then v1 else v0 end as leave, cast(round_even(case when dir > 0 then azimuth else azimuth + 180 end, 0) as bigint) as heading from n),
m as (select *, unnest([{{'seq': 0, 'l': 'S', 'd': ' start of run-in, steer ' || lpad(cast(heading as varchar), 3, '0') || '°T', 'v': enter - dir * 150}}, {{'seq': 1, 'l': 'A', 'd': ' recording on', 'v': enter + dir * 54}},
    {{'seq': 2, 'l': 'E', 'd': ' recording off', 'v': leave + dir * 54}}, {{'seq': 3, 'l': 'T', 'd': ' turn away', 'v': leave + dir * 100}}]) as p from e)
select azimuth, line, p.seq as seq, 'L' || lpad(cast(line + 1 as varchar), 2, '0') || p.l as name, 'line ' || (line + 1) || p.d as desc, round(u, 5) + 0 as u, round(p.v, 5) + 0 as v from m
""")
def plan_steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rig = planner.Rig(run_out_m=100.0)
    boxes = planner.plan_boxes(v.targets(spark, sf_dir), planner.azimuth_steps(spark), planner.Sonar())
    marks = plan_export.steering_points(planner.plan_runs(planner.plan_lines(boxes, rig, spread=False), rig))
    return marks.select("azimuth", "line", "seq", "name", "desc", r("u", 5), r("v", 5))


@query()
def plan_turn_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ship's whole way of every plan, turns thinned to a metre."""
    _, _, runs = _plans(spark, sf_dir)
    return plan_export.path_points(runs, planner.plan_turns(runs, RIG)).select("azimuth", "seq", r("u", 5), r("v", 5))
