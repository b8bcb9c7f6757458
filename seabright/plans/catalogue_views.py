"""Registered queries of contacts, layers, boxes and recorded values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.functions import acoustics as ac
from seabright.operators import contacts, layers, pings, report
from seabright.plans import views as v
from seabright.plans.survey_views import query, r
from seabright.sources import jsf


@query("""
select event_id, case user_id % 4 when 2 then round(event_id * 1000 / 1e4::double / 60, 8) when 3 then round(event_id * 1000 / 1e6::double, 8) end as degrees,
case event_id % 50 + 60 when 80 then 'sonar data' when 82 then 'sonar data (compressed)' when 86 then 'sonar data 2' else 'unknown' end as message,
case event_id % 110 when 0 then 'sub-bottom' when 20 then 'sidescan (set 1)' when 21 then 'sidescan (set 2)' when 100 then 'NMEA/nav' when 101 then 'pressure' when 102 then 'analog' else 'unknown' end as subsystem from events
""")
def recorded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    degrees = ac.coord_to_degrees((k * 1000).cast("double"), F.col("user_id") % 4)
    return v.table(spark, sf_dir, "events").select("event_id", r(degrees, 8, "degrees"), jsf.named(k % 50 + 60, jsf.MESSAGE_NAMES).alias("message"), jsf.named(k % 110, jsf.SUBSYSTEM_NAMES).alias("subsystem"))


@query(f"""
with {v.PINGS}, b as (select dataset, subsystem, min(lat) filter (lat <> 0) as s, max(lat) filter (lat <> 0) as n, min(lon) filter (lon <> 0) as w, max(lon) filter (lon <> 0) as e from v_pings group by all)
select dataset, round(min(s), 6) as south, round(max(n), 6) as north, round(min(w), 6) as west, round(max(e), 6) as east, round((min(s) + max(n)) / 2, 6) as lat, round((min(w) + max(e)) / 2, 6) as lon from b group by 1
""")
def united_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = pings.bounds(v.pings(spark, sf_dir), "dataset", "subsystem")
    return pings.united(boxes, "dataset").select("dataset", *(r(c) for c in ("south", "north", "west", "east", "lat", "lon")))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return v.table(spark, sf_dir, "supplier").select(
        F.when(k % 10 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.format_string("C%03d", k)).alias("id"), F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.when(k % 3 == 0, "datum").otherwise("pick").alias("source"),
        F.when(k % 5 == 0, 0.0).otherwise(F.col("s_suppkey") * 1.5).alias("radius"), (52 + k * 1e-4).alias("lat"), (4 + k * 1e-4).alias("lon"),
    )


_CONTACTS = """v_contacts as (select case when s_suppkey % 10 = 0 then 'X' || s_suppkey else printf('C%03d', s_suppkey) end as id, case when s_suppkey % 4 <> 0 then s_name end as name, case when s_suppkey % 3 = 0 then 'datum' else 'pick' end as source,
    case when s_suppkey % 5 = 0 then 0 else s_suppkey * 1.5::double end as radius from supplier)"""


@query(f"with {_CONTACTS} select id, coalesce(name, id) as name, case when radius > 0 then radius else 50 end::double as radius from v_contacts where source = 'datum'")
def datum_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.targets_from(_contacts(spark, sf_dir)).select("id", "name", "radius")


@query(f"with {_CONTACTS}, w as (select unnest(['C007', 'X10', 'C003', 'nobody']) as id, unnest([0, 1, 2, 3]) as place) select place, id, coalesce(name, id) as name, case when radius > 0 then radius else 50 end::double as radius from w join v_contacts using (id)")
def chosen_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.targets_from(_contacts(spark, sf_dir), ["C007", "X10", "C003", "nobody"]).select("place", "id", "name", "radius")


@query(f"with {_CONTACTS} select printf('C%03d', coalesce(max(try_cast(substr(id, 2) as integer)) filter (id like 'C%'), 0) + 1) as id from v_contacts")
def next_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.next_id(_contacts(spark, sf_dir))


@query(f"""
with {_CONTACTS}, c as (select 'C001' as id, 'moved' as name, 'pick' as source, 9::double as radius union all select 'C9999', 'new', 'datum', 1)
select id, name, source, radius from v_contacts where id not in (select id from c) union all select * from c
""")
def upserted_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contacts(spark, sf_dir).select("id", "name", "source", "radius")
    changes = spark.createDataFrame([("C001", "moved", "pick", 9.0), ("C9999", "new", "datum", 1.0)], "id string, name string, source string, radius double")
    return contacts.upsert(rows, changes)


@query("""
with recursive l as (select n_nationkey as id, case when n_nationkey = 0 then null else n_nationkey // 2 end as parent, n_nationkey % 7 <> 3 as shown from nation),
t as (select id, shown as ok from l where parent is null union all select l.id, t.ok and l.shown from l join t on l.parent = t.id) select id from t where ok
""")
def visible_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    tree = v.table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k != 0, F.floor(k / 2)).alias("parent"), (k % 7 != 3).alias("shown"))
    return contacts.visible(tree).select("id")


_BANDS = f"""{v.PINGS}, v_bands as (select dataset, subsystem, max(f0) as f0, max(f1) as f1, case when dataset % 3 = 0 then 0 else 100000 + subsystem * 1000 end::double as centre from v_pings group by 1, 2)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.pings(spark, sf_dir).groupBy("dataset", "subsystem").agg(F.max("f0").alias("f0"), F.max("f1").alias("f1"))
    return rows.withColumn("centre", F.when(F.col("dataset") % 3 == 0, 0.0).otherwise(100000.0 + F.col("subsystem") * 1000))


_TITLES = """c as (select *, case when centre > 0 then cast(floor(centre / 1000 + 0.5) as bigint) when f0 + f1 > 0 then cast(floor((f0 + f1) / 2000 + 0.5) as bigint) end as khz, case when f1 <> f0 then cast(floor(abs(f1 - f0) / 1000 + 0.5) as bigint) end as sweep from {rows}),
n as (select *, count(khz) over w as known, max(khz) over w as most from c window w as (partition by {by})),
t as (select *, case when known = 2 and khz is not null then case when khz = most then 'High frequency' else 'Low frequency' end when khz is not null then khz || ' kHz' else 'Channel ss' || subsystem end as title from n),
named as (select *, case when title <> khz || ' kHz' then khz || ' kHz · ' else '' end || case when sweep is not null then sweep || ' kHz sweep · ' else '' end || 'ss' || subsystem as subtitle from t)"""


@query(f"with {_BANDS}, {_TITLES.format(rows='v_bands', by='dataset')} select dataset, subsystem, title, subtitle from named")
def band_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.band_titles(_bands(spark, sf_dir), "dataset").select("dataset", "subsystem", "title", "subtitle")


@query(f"""
with {_BANDS}, d as (select distinct dataset, dataset % 4 as project from v_pings where dataset % 5 <> 1), own as (select * from d join v_bands using (dataset)),
firsts as (select *, row_number() over (partition by project, subsystem order by centre <= 0, dataset) as nth from own), merged as (select project, subsystem, f0, f1, centre from firsts where nth = 1), {_TITLES.format(rows='merged', by='project')},
every as (select project, -1 as spot, 'ov-' || subsystem as chart, 'overview' as kind, '' as dataset, subsystem, 'Coverage — ' || title as title, subtitle from named
    union all select o.project, o.dataset, 'ds-' || o.dataset || '-' || o.subsystem, 'dataset', o.dataset::varchar, o.subsystem, title, subtitle from own o join named using (project, subsystem))
select project, row_number() over (partition by project order by spot, subsystem) - 1 as place, chart, kind, dataset, subsystem, title, subtitle from every
""")
def report_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = v.pings(spark, sf_dir).where(F.col("dataset") % 5 != 1).select((F.col("dataset") % 4).alias("project"), "dataset").distinct().withColumn("at", F.col("dataset"))
    plan = report.chart_plan(datasets.withColumn("dataset", F.col("dataset").cast("string")), _bands(spark, sf_dir).withColumn("dataset", F.col("dataset").cast("string")))
    return plan.withColumn("place", F.col("place").cast("long"))


@query("""
with c as (select l_partkey % 64 as gx, l_suppkey % 64 as gy, avg(l_extendedprice) as value from lineitem group by all), s as (select list(value order by value) as l from c)
select round(l[1], 4) as least, round(l[len(l)], 4) as most, len(l) as filled, round(l[cast(floor((len(l) - 1) * 0.02::double + 0.5) as bigint) + 1], 4) as p2, round(l[cast(floor((len(l) - 1) * 0.98::double + 0.5) as bigint) + 1], 4) as p98 from s
""")
def imported_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = v.samples(spark, sf_dir).groupBy("gx", "gy").agg(F.avg("amp").alias("value"))
    return layers.statistics(cells).select(r("least", 4), r("most", 4), "filled", r("p2", 4), r("p98", 4))
