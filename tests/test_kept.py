import json
import threading

import pytest
from pyspark.sql import functions as F

from seabright.functions import geodesy as geo
from seabright.operators import imaging, kept
from seabright.sources import catalogue, geojson
from seabright.sources.files import Files


def test_results_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5).withColumnRenamed("id", "gx")

    folder, settings = str(tmp_path / "mosaics"), {"subsystem": 20, "layback": 44.0}
    for _ in range(2):
        assert kept.kept(spark, folder, settings, make).count() == 5
    assert len(made) == 1 and kept.found(spark, folder, {"subsystem": 21}) is None
    key = next(p for p in (tmp_path / "mosaics").iterdir() if not p.name.startswith("."))
    (key / "_SUCCESS").unlink()  # a half-written result
    assert kept.found(spark, folder, settings) is None and kept.kept(spark, folder, settings, make).count() == 5 and len(made) == 2
    (key / kept.SETTINGS).write_text(json.dumps({"other": 1}))
    assert kept.kept(spark, folder, settings, make).count() == 5 and len(made) == 3
    assert not [p for p in (tmp_path / "mosaics").iterdir() if p.name.startswith(".") and p.is_dir()]


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    folder = str(tmp_path / "mosaics")
    with pytest.raises(Exception, match="boom"):
        kept.kept(spark, folder, {"a": 1}, lambda: spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("x")))
    assert kept.found(spark, folder, {"a": 1}) is None and Files(spark).folders(folder) == []


def test_the_newest_are_kept(spark, tmp_path):
    folder = str(tmp_path / "mosaics")
    for k in range(6):
        kept.kept(spark, folder, {"k": k}, lambda: spark.range(1), keep=4)
    assert len(Files(spark).folders(folder)) == 4 and kept.found(spark, folder, {"k": 5}) is not None and kept.found(spark, folder, {"k": 0}) is None


def test_two_that_make_it_at_once(spark, tmp_path):
    folder, gate, got = str(tmp_path / "mosaics"), threading.Barrier(2), []

    def make():
        gate.wait(60)
        return spark.range(7)

    both = [threading.Thread(target=lambda: got.append(kept.kept(spark, folder, {"k": 1}, make).count())) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join(120)
    assert got == [7, 7] and len(Files(spark).folders(folder)) == 1


def test_contacts_are_saved_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "marks.geojson")
    assert catalogue.load_contacts(spark, path).rows.count() == 0
    rows = spark.createDataFrame([("C002", "b", 52.0, 4.0), ("C001", "a \"q\"", 51.0, 3.0)], "id string, name string, lat double, lon double")
    catalogue.save_contacts(rows, path, "north sea")
    assert json.loads(open(path).read())["properties"]["project"] == "north sea"
    loaded = catalogue.load_contacts(spark, path)
    assert [(r.id, r.name, r.lat) for r in loaded.rows.orderBy("id").collect()] == [("C001", "a \"q\"", 51.0), ("C002", "b", 52.0)]
    catalogue.save_contacts(catalogue.Contacts(rows.where("id = 'C001'")), path)
    assert catalogue.load_contacts(spark, path).rows.count() == 1 and len(json.loads(open(path + ".bak").read())["features"]) == 2
    for text in ('{"type":"FeatureCollection","features":[{"properties":{"id":"C001"}},{"geometry":{"coordinates":[3,51]},"properties":{"id":"C002"}}]}', "{half a file"):
        open(path, "w").write(text)
        with pytest.raises(ValueError):
            catalogue.load_contacts(spark, path)
        sealed = catalogue.load_contacts_or_seal(spark, path)
        assert sealed.sealed and sealed.rows.count() == 0
        with pytest.raises(PermissionError):
            catalogue.save_contacts(sealed, path)
        assert open(path).read() == text
    assert geojson.read_contacts(spark, path + ".bak").count() == 2


def test_coordinates_as_people_write_them(spark):
    told = {
        ("N5125.2300", True): 51 + 25.23 / 60, ("00309.3400", False): 3 + 9.34 / 60, ("51.4205", True): 51.4205, ("W 3 30", False): -3.5, ("-3.5", False): -3.5, ("S-3", True): 3.0, ("51°24'30\"", True): 51 + 24.5 / 60, (" 4 ", False): 4.0,
        ("179.5", False): 179.5, ("180", False): 180.0, ("N 3", False): None, ("E 3", True): None, ("91", True): None, ("5160.1", True): None, ("3 60", False): None, ("3 5 60", False): None, ("+3", True): None, ("3,5", True): None, ("", True): None,
        ("abc", True): None, (None, True): None, ("3.", True): None, ("1 2 3 4", True): 1 + 2 / 60 + 3 / 3600,
    }
    df = spark.createDataFrame([(i, t, lat) for i, (t, lat) in enumerate(told)], "i int, t string, is_lat boolean")
    got = {r.i: r.d for r in df.select("i", F.when(F.col("is_lat"), imaging.parsed_coordinate(F.col("t"), True)).otherwise(imaging.parsed_coordinate(F.col("t"), False)).alias("d")).collect()}
    for i, (case, want) in enumerate(told.items()):
        assert got[i] == (None if want is None else pytest.approx(want)), case


def test_printed_numbers(spark):
    one = spark.range(1)
    text = lambda c: one.select(c.alias("x")).first().x
    assert [text(imaging.distance_text(F.lit(float(m)))) for m in (12_345, 1005, 250.4, 12.34, 0.256)] == ["12 km", "1.01 km", "250 m", "12.3 m", "26 cm"]
    assert [text(imaging.bridge_coordinate(F.lit(v), lat)) for v, lat in ((51.4205, True), (-3.155, False), (float("nan"), True))] == ["N5125.2300", "W00309.3000", ""]
    size = lambda *b: tuple(text(imaging.chart_size(*(F.lit(float(x)) for x in b))))
    assert size(52, 4, 52.1, 4.01) == (800, 1600) and size(52, 4, 52, 4) == (1600, 1600) and size(0, 0, 1, 1.5) == (1600, 1067)
    assert text(geo.suggested_systems(F.lit(52.0), F.lit(4.0))) == [4326, 32631, 28992, 3035, 23031] and text(geo.suggested_systems(F.lit(-30.0), F.lit(150.0))) == [4326, 32756]
    assert [text(c) for c in geo.formatted(4326, F.lit(52.5), F.lit(4.0))] == ["4.00000000", "52.50000000"]
