"""Queries of imported rasters and their tiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.operators import layer_tree, layers
from seabright.plans import views as v
from seabright.plans.survey_views import query, r

WIDE, AFFINE, ZOOM = 211, [1.2e-5, 0.0, 4.0, 0.0, -0.9e-5, 52.6], 18

_PIXELS = f"""pixels as (
    select *, o_orderkey % {WIDE} as col, o_orderkey // {WIDE} as row, (select max(o_orderkey) // {WIDE} + 1 from orders) as tall from orders
), placed as (
    select *, ((col + 0.5::double) * 1.2e-5::double + 4::double + 180) / 360 * 67108864::double as px, ((col + 1.5::double) * 1.2e-5::double + 4::double + 180) / 360 * 67108864::double as px2,
        (0.5::double - atanh(sin(radians((row + 0.5::double) * -0.9e-5::double + 52.6::double))) / (2 * pi())) * 67108864::double as py,
        (0.5::double - atanh(sin(radians((row + 1.5::double) * -0.9e-5::double + 52.6::double))) / (2 * pi())) * 67108864::double as py2 from pixels
), wide as (
    select *, unnest(range(cast(floor(px) as bigint), cast(floor(px) as bigint) + case when col + 1 < {WIDE} then cast(greatest(ceil(abs(px2 - px)), 1) as bigint) else 1 end)) as gx from placed
), covered as (
    select *, unnest(range(cast(floor(py) as bigint), cast(floor(py) as bigint) + case when row + 1 < tall then cast(greatest(ceil(abs(py2 - py)), 1) as bigint) else 1 end)) as gy from wide
)"""


def _covered(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Orders as the pixels of a raster in degrees, 211 across, and the cells that each covers."""
    k = F.col("o_orderkey")
    pixels = v.table(spark, sf_dir, "orders").select((k % WIDE).alias("col"), F.floor(k / WIDE).alias("row"), *columns)
    tall = pixels.agg(F.max("row")).first()[0] + 1
    frame = layers.raster_frame(spark, 4326, AFFINE, WIDE, tall, ZOOM)
    return layers.footprints(pixels, frame, AFFINE, WIDE, tall)


@query(f"""
with {_PIXELS}, seen as (select * from covered where o_orderkey % 5 <> 0), last as (select gx, gy, arg_max(o_orderkey, row * {WIDE} + col) as k from seen group by 1, 2)
select gx, gy, cast(k % 256 as integer) as r, cast(k * 7 % 256 as integer) as g, cast(k * 13 % 256 as integer) as b, 255 as a from last
""")
def imported_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    colour = (k % 256) * 2**24 + (k * 7 % 256) * 2**16 + (k * 13 % 256) * 2**8 + F.when(k % 5 == 0, 0).otherwise(255)
    return layers.last_cells(_covered(spark, sf_dir, colour.cast("long").alias("colour")).where(F.col("colour") % 256 != 0))


@query(f"with {_PIXELS} select gx, gy, round(avg(o_totalprice), 4) as value, count(*) as n from covered group by 1, 2")
def imported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.mean_cells(_covered(spark, sf_dir, F.col("o_totalprice").alias("value"))).select("gx", "gy", r("value", 4), "n")


_METRES = "(2 * pi() * 6378137::double / (256 * power(2, zoom)) * cos(atan(sinh(pi() * (1 - 2 * 1380350::double / 4194304)))))"


@query(f"""
with cells as (select 2100000 + l_orderkey % 900 as gx, 1380000 + l_partkey % 700 as gy, max((l_orderkey % 997)::double + l_quantity) as value from lineitem group by 1, 2),
levels as (select 14 - k as zoom, gx >> k as gx, gy >> k as gy, sum(value) / count(*) as value from cells, (select unnest(range(11)) as k) group by 1, 2, 3),
near as (
    select c.*, case when e.value is not null and w.value is not null then (e.value - w.value) / (2 * {_METRES.replace('zoom', 'c.zoom')}) * 0.5::double else 0 end as dx,
        case when n.value is not null and s.value is not null then (n.value - s.value) / (2 * {_METRES.replace('zoom', 'c.zoom')}) * 0.5::double else 0 end as dy
    from levels c left join levels e on e.zoom = c.zoom and e.gx = c.gx + 1 and e.gy = c.gy left join levels w on w.zoom = c.zoom and w.gx = c.gx - 1 and w.gy = c.gy
    left join levels n on n.zoom = c.zoom and n.gx = c.gx and n.gy = c.gy - 1 left join levels s on s.zoom = c.zoom and s.gx = c.gx and s.gy = c.gy + 1
)
select zoom, gx, gy, round(value, 4) as value, round(least(greatest((-dx * cos(radians(-225)) * cos(radians(40)) - dy * sin(radians(-225)) * cos(radians(40)) + sin(radians(40))) / sqrt(dx * dx + dy * dy + 1), 0), 1), 6) as light from near
""")
def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and light of every pixel of eleven zooms; values are whole numbers, so that their sums are exact."""
    cells = v.table(spark, sf_dir, "lineitem").groupBy((2_100_000 + F.col("l_orderkey") % 900).alias("gx"), (1_380_000 + F.col("l_partkey") % 700).alias("gy")).agg(F.max((F.col("l_orderkey") % 997).cast("double") + F.col("l_quantity")).alias("sum"))
    levels = layers.pyramid(cells.withColumn("n", F.lit(1)), ["sum"], "n", 14, 4)
    lit = layers.tile_light(levels, layers.Style(0.0, 1.0, exaggeration=0.5), 14, 1_380_350)
    return lit.select("zoom", "gx", "gy", r("value", 4), r("light", 6))


_LAYERS = """v_layers as (
    select c_nationkey as project, -k as place, 'n' || k as id, case when k % 7 <> 0 then 'n' || (k // 3) end as parent, k % 11 <> 5 as visible
    from (select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as k from customer)
), known as (
    select l.*, u.id as up from v_layers l left join v_layers u on l.project = u.project and l.parent = u.id
)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as a project's layers."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    rows = v.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), k.alias("k"))
    named = lambda n: F.concat(F.lit("n"), n.cast("string"))
    parent = F.when(F.col("k") % 7 != 0, named(F.floor(F.col("k") / 3)))
    return rows.select("project", (-F.col("k")).alias("place"), named(F.col("k")).alias("id"), parent.alias("parent"), (F.col("k") % 11 != 5).alias("visible"))


@query(f"""
with recursive {_LAYERS}, walk as (
    select project, id, [place] as path, 0 as depth, visible as shown from known where up is null
    union all select k.project, k.id, list_append(w.path, k.place), w.depth + 1, w.shown and k.visible from known k join walk w on k.project = w.project and k.up = w.id
)
select project, id, row_number() over (partition by project order by path) - 1 as place, depth, shown from walk
""")
def layer_pre_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(spark, sf_dir)
    return layer_tree.normalised(rows).select("project", "id", "place").join(layer_tree.tree(rows).select("project", "id", "depth", "shown"), ["project", "id"])


@query(f"""
with recursive {_LAYERS}, gone as (
    select project, id from known where id in ('n5', 'n14') union all select k.project, k.id from known k join gone g on k.project = g.project and k.up = g.id
) select project, id from v_layers where (project, id) not in (select (project, id) from gone)
""")
def layers_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(spark, sf_dir)
    return layer_tree.removed(rows, rows.where(F.col("id").isin("n5", "n14"))).select("project", "id")
