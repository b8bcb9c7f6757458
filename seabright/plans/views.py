"""The driver's tables seen as survey tables: the same projections in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ping records; a dataset is ten users' worth."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.floor(u / 10).alias("dataset"), e.alias("rec_id"), (micros(F.col("ts")) / 1e6).alias("time"),
        (20 + u % 2).alias("subsystem"), (F.floor(u / 2) % 2).alias("channel"),
        F.when(e % 97 == 0, 0.0).otherwise(52.5 + (e % 1000) * 1e-5).alias("lat"), F.when(e % 97 == 0, 0.0).otherwise(4.0 + ((e * 7) % 1000) * 1e-5).alias("lon"),
        ((e * 37) % 360).cast("double").alias("heading"), F.col("value").alias("altitude"), (e % 128).alias("validity"),
        (500 + e % 1500).alias("nsamples"), (20000 + (e % 4) * 1000).alias("interval_ns"),
        F.when(e % 11 == 0, 0.0).otherwise(400000.0 + (e % 5) * 1000.0).alias("f0"), F.when(e % 11 == 0, 0.0).otherwise(420000.0 + (e % 5) * 1500.0).alias("f1"),
    )


PINGS = """v_pings as (
    select user_id // 10 as dataset, event_id as rec_id, epoch_us(ts) / 1e6::double as time, 20 + user_id % 2 as subsystem, (user_id // 2) % 2 as channel,
        case when event_id % 97 = 0 then 0::double else 52.5::double + (event_id % 1000)::double * 1e-5::double end as lat,
        case when event_id % 97 = 0 then 0::double else 4::double + ((event_id * 7) % 1000)::double * 1e-5::double end as lon,
        ((event_id * 37) % 360)::double as heading, value as altitude, event_id % 128 as validity, 500 + event_id % 1500 as nsamples, 20000 + (event_id % 4) * 1000 as interval_ns,
        case when event_id % 11 = 0 then 0::double else 400000::double + (event_id % 5) * 1000::double end as f0, case when event_id % 11 = 0 then 0::double else 420000::double + (event_id % 5) * 1500::double end as f1
    from events
)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fixes of a recording for each customer, a fix a minute apart on a meandering course."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), seq.cast("long").alias("seq"), F.col("o_orderkey").alias("k"))
    return rows.select("dataset", "seq", (F.col("seq") * 60.0).alias("time"), (52.5 + F.col("seq") * 1e-4 + (F.col("k") % 7) * 1e-5).alias("lat"), (4.0 + (F.col("k") % 13) * 1e-5 + F.col("seq") * 5e-5).alias("lon"))


FIXES = """v_fix0 as (select o_custkey as dataset, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as seq, o_orderkey as k from orders),
v_fixes as (
    select dataset, seq, seq * 60::double as time, 52.5::double + seq::double * 1e-4::double + (k % 7)::double * 1e-5::double as lat, 4::double + (k % 13)::double * 1e-5::double + seq::double * 5e-5::double as lon from v_fix0
)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as traces of amplitudes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000).alias("data"), F.col("label").alias("setting"))


TRACES = """v_traces as (select vec_id as rec_id, list_transform(embedding, lambda x: abs(x::double) * 1000::double) as data, label as setting from embeddings)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as painted samples: cell, amplitude, angle."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("gx"), (F.col("l_suppkey") % 64).alias("gy"), F.col("l_extendedprice").alias("amp"), (F.col("l_quantity") * 1.8).alias("theta"))


SAMPLES = """v_samples as (select l_partkey % 64 as gx, l_suppkey % 64 as gy, l_extendedprice as amp, l_quantity * 1.8::double as theta from lineitem)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as search targets."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("target"), ((k * 37) % 400).cast("double").alias("x"), ((k * 91) % 300).cast("double").alias("y"), (20.0 + k % 30).alias("radius"))


TARGETS = """v_targets as (select s_suppkey as target, ((s_suppkey * 37) % 400)::double as x, ((s_suppkey * 91) % 300)::double as y, 20::double + s_suppkey % 30 as radius from supplier)"""
