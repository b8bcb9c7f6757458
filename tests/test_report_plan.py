import pytest

from seabright.operators import mosaic, report

LAYERS = [
    ("p", 0, "rec:a", "recording", "a", None, None, None), ("p", 1, "m20", "mosaic", "a", 20, None, None), ("p", 2, "m21", "mosaic", "a", 21, None, None), ("p", 3, "fish", "track", "a", None, True, False), ("p", 4, "boat", "track", "a", None, False, True),
    ("p", 5, "mb", "mosaic", "b", 20, None, None), ("p", 6, "grid", "raster", None, None, None, None), ("p", 7, "way", "vector", None, None, None, None), ("p", 8, "mc", "mosaic", "gone", 20, None, None),
]


@pytest.fixture(scope="module")
def plan(spark):
    datasets = spark.createDataFrame([("p", "b", 1), ("p", "a", 0), ("q", "c", 0)], "project string, dataset string, at int")
    bands = spark.createDataFrame([("a", 20, 100_000.0, 150_000.0, 0.0), ("a", 21, 390_000.0, 430_000.0, 0.0), ("b", 20, 100_000.0, 150_000.0, 1_435_720.0), ("c", 20, 0.0, 0.0, 0.0)], "dataset string, subsystem int, f0 double, f1 double, centre double")
    return datasets, report.chart_plan(datasets, bands)


def test_charts(plan):
    _, charts = plan
    got = [(r.chart, r.kind, r.dataset, r.title, r.subtitle) for r in charts.where("project = 'p'").orderBy("place").collect()]
    high, low = "1436 kHz · 50 kHz sweep · ss20", "410 kHz · 40 kHz sweep · ss21"
    assert got == [
        ("ov-20", "overview", "", "Coverage — High frequency", high), ("ov-21", "overview", "", "Coverage — Low frequency", low), ("ds-a-20", "dataset", "a", "High frequency", high), ("ds-a-21", "dataset", "a", "Low frequency", low), ("ds-b-20", "dataset", "b", "High frequency", high),
    ]
    assert [(r.title, r.subtitle) for r in charts.where("project = 'q' and kind = 'dataset'").collect()] == [("Channel ss20", "ss20")]


def test_layers_and_legends(spark, plan):
    datasets, charts = plan
    layers = spark.createDataFrame(LAYERS, "project string, place int, id string, kind string, dataset string, subsystem int, show_fish boolean, show_boat boolean")
    offered = report.chart_layers(charts, layers, datasets).cache()
    of = lambda c: {r.id: (r.on, r.boat, r.fish) for r in offered.where(f"chart = '{c}'").collect()}
    assert of("ov-20") == {"m20": (True, True, False), "mb": (True, True, False), "fish": (False, False, True), "boat": (True, True, False), "grid": (False, False, True), "way": (False, False, True)}
    assert of("ds-a-21") == {"m21": (True, True, True), "fish": (True, False, True), "boat": (False, True, False), "grid": (False, False, True), "way": (False, False, True)}
    stored = spark.createDataFrame([("p", "ds-a-21", "grid", True, None, None), ("p", "ds-a-21", "m21", False, None, None), ("p", "ds-a-21", "boat", None, True, False), ("p", "ds-a-21", "lost", True, True, True)], "project string, chart string, id string, on boolean, boat boolean, fish boolean")
    chosen = report.with_choices(offered, stored)
    styles = spark.createDataFrame([("p", "grid", "raster", "Depths", "", "12 x 9", "viridis"), ("p", "fish", "track", None, "#ff0000", None, None), ("p", "boat", "track", "Ship", "", None, None), ("p", "m21", "mosaic", "x", "", None, "grey")], "project string, id string, kind string, label string, colour string, info string, ramp string")
    rows = report.legends(chosen, styles).where("chart = 'ds-a-21'").orderBy("place").collect()
    assert [(r.label, r.colour, r.detail) for r in rows] == [("fish", "#ff0000", "towfish track"), ("Ship", "#35b8a6", "vessel track"), ("Depths", "", "12 x 9")]
    first, last = (mosaic.RAMPS["viridis"][k][1:] for k in (0, -1))
    assert rows[2].ramp[0] == "#%02x%02x%02x" % first and rows[2].ramp[-1] == "#%02x%02x%02x" % last and len(rows[2].ramp) == 7
    page = report.legend_html(rows, "Top <first>")
    assert page.count("<li>") == 3 and "linear-gradient(to right,#" in page and "&lt;first&gt;" in page and report.legend_html([], "x") == ""


def test_contact_positions(spark):
    contacts = spark.createDataFrame([("C2", 52.5, 4.02), ("C1", -33.0, 151.0)], "id string, lat double, lon double")
    got = {(r.id, r.epsg): (r.x, r.y) for r in report.contact_positions(contacts.where("id = 'C2'")).collect()}
    assert got[("C2", 4326)] == ("4.02000000", "52.50000000") and got[("C2", 32631)][0].startswith("569239.")
    assert {r.epsg for r in report.contact_positions(contacts, [28992, 28992]).collect()} == {4326, 28992}
    assert report.contact_positions(contacts.limit(0)).count() == 0
