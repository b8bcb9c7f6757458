"""What a workspace keeps: recordings, indexes, rasters, contacts and projects, read and written by Spark so that any path it knows works."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seabright.operators.contacts import iso8601
from seabright.sources import geojson
from seabright.sources.files import Files

MOST_CONTACTS = 100_000

PROJECT = """name string, datasets array<struct<name: string, enabled: boolean>>, layers array<struct<id: string, parent: string, name: string, kind: string, shown: boolean>>,
    charts array<struct<title: string, layers: array<string>>>, view map<string, string>"""


def sonar_files(spark: SparkSession, folder: str) -> DataFrame:
    """folder, path, length, modified of the recordings to read: a folder's JSF files, and its XTF files only where it has none, so that no ping is read twice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.withColumns({"kind": kind, "folder": F.regexp_extract("path", "^(.*)/[^/]*$", 1)}).where(F.col("kind").isin("jsf", "xtf"))
    any_jsf = F.max((F.col("kind") == "jsf").cast("int")).over(Window.partitionBy("folder")) == 1
    return files.withColumn("any_jsf", any_jsf).where(~F.col("any_jsf") | (F.col("kind") == "jsf")).select("folder", "path", "length", "modified")


def save_index(index: DataFrame, path: str) -> None:
    """The ping index as Parquet, a folder for each recording, sorted by time."""
    index.repartition("dataset").sortWithinPartitions("dataset", "time", "rec_id").write.mode("overwrite").partitionBy("dataset").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_raster(cells: DataFrame, path: str, header: dict, side: int = 256) -> None:
    """Cells (gx, gy, ...) as Parquet by columns of tiles of ``side`` cells, and the header as a row beside them."""
    cells.withColumns({"tx": F.floor(F.col("gx") / side), "ty": F.floor(F.col("gy") / side)}).repartition("tx").sortWithinPartitions("tx", "ty", "gy", "gx").write.mode("overwrite").partitionBy("tx").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([header]).coalesce(1).write.mode("overwrite").json(f"{path}/header")


def load_raster(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Cells and header; a filter on tx reads those tiles only."""
    return spark.read.parquet(f"{path}/cells"), spark.read.json(f"{path}/header").first().asDict()


@dataclass
class Contacts:
    """A project's contacts. ``sealed`` ones stand for a file that could not be read and are never written over it."""

    rows: DataFrame | None
    sealed: bool = False


def load_contacts(spark: SparkSession, path: str) -> Contacts:
    """The contacts of a file; none where there is no file. A file of which any feature cannot be read is refused whole: writing back what is left would delete the rest."""
    if not Files(spark).exists(path):
        return Contacts(spark.createDataFrame([], geojson.CONTACT))
    try:
        rows = geojson.read_contacts(spark, path)
        lost, every = rows.agg(F.count_if(F.col("id").isNull() | F.col("lat").isNull() | F.col("lon").isNull()), F.count("*")).first()
    except Exception as e:
        raise ValueError(f"{path} is no list of contacts") from e
    if lost:
        raise ValueError(f"{lost} of {every} contacts in {path} could not be read")
    return Contacts(rows)


def load_contacts_or_seal(spark: SparkSession, path: str) -> Contacts:
    """As ``load_contacts``, but a file that is refused gives an empty, sealed list."""
    try:
        return load_contacts(spark, path)
    except ValueError:
        return Contacts(spark.createDataFrame([], geojson.CONTACT), sealed=True)


def save_contacts(contacts: DataFrame | Contacts, path: str, project: str | None = None) -> None:
    """One feature collection in one file. It is written aside and renamed, and the last version stays beside it as ``.bak``. A project's contacts are a list that people keep: it goes through the driver."""
    if isinstance(contacts, Contacts):
        if contacts.sealed:
            raise PermissionError("the contacts file could not be read, so it will not be overwritten")
        contacts = contacts.rows
    spark, files = contacts.sparkSession, Files(contacts.sparkSession)
    many = contacts.count()
    if many > MOST_CONTACTS:
        raise ValueError(f"{many} contacts are no list that people keep")
    features = [r.feature for r in geojson.contact_features(contacts).orderBy("id").collect()]
    about = "" if project is None else f'"properties":{{"project":{json.dumps(project)},"exported":"{spark.range(1).select(iso8601(F.unix_timestamp().cast("double"))).first()[0]}"}},'
    if files.exists(path):
        files.copy(path, f"{path}.bak")
    files.write(f"{path}.tmp", f'{{"type":"FeatureCollection",{about}"features":[{",".join(features)}]}}')
    files.rename(f"{path}.tmp", path, replace=True)


def load_project(spark: SparkSession, path: str) -> DataFrame:
    """Projects of JSON documents; fields that one lacks are null, fields unknown here are left out."""
    return spark.read.schema(PROJECT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def save_project(project: DataFrame, path: str) -> None:
    project.coalesce(1).write.mode("overwrite").json(path)
