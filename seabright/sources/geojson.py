"""GeoJSON features of contacts, tracks and plans, written and read by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTACT = "id string, name string, class string, source string, lat double, lon double, radius double, note string, created string"


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def line(points: Column) -> Column:
    """Of an array of structs with lon and lat."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def feature(geometry: Column, *properties: str) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def contact_features(contacts: DataFrame) -> DataFrame:
    """id, feature: all of a contact's fields are its properties."""
    return contacts.select("id", feature(point(F.col("lon"), F.col("lat")), *contacts.columns).alias("feature"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contacts of feature collections; fields that a file lacks are null. A file that is no collection fails the read."""
    named = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in CONTACT.split(", "))
    schema = f"features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<{named}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return rows.select("f.properties.*", at.alias("at")).withColumns({"lon": F.coalesce("lon", F.get("at", 0)), "lat": F.coalesce("lat", F.get("at", 1))}).drop("at")


def track_features(fixes: DataFrame) -> DataFrame:
    """dataset, feature: a line for each recording's fixes (dataset, seq, lat, lon)."""
    points = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    lines = fixes.groupBy("dataset").agg(points.alias("points"))
    return lines.select("dataset", feature(line(F.col("points")), "dataset").alias("feature"))
