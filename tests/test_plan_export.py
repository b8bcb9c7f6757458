import json
import math

import numpy as np
import pytest

from seabright.operators import plan_export, planner
from seabright.sources import gpx


@pytest.fixture(scope="module")
def plans(spark):
    sonar, rig = planner.Sonar(mode="custom", spacing_m=150.0), planner.Rig(run_out_m=10.0)
    targets = spark.createDataFrame([(0, 0.0, 0.0, 60.0), (1, 200.0, 300.0, 45.0)], "target int, x double, y double, radius double")
    boxes = planner.plan_boxes(targets, planner.azimuth_steps(spark, 45.0), sonar)
    lines = planner.plan_lines(boxes, rig)
    runs = planner.plan_runs(lines, rig).cache()
    return sonar, rig, boxes.cache(), lines.cache(), runs, planner.plan_turns(runs, rig).cache()


def test_thinned_turns_stay_near_their_arcs():
    assert plan_export.thinned([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)]) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    arc = [(40 * math.cos(a), 40 * math.sin(a)) for a in np.linspace(0, math.pi, 27)]
    kept = plan_export.thinned(arc)
    assert 5 <= len(kept) <= 12 and kept[0] == arc[0] and kept[-1] == arc[-1]
    assert plan_export.thinned([(0, 0), (5, 0), (0, 0)]) == [(0, 0), (5, 0), (0, 0)] and plan_export.thinned([(1, 1), (2, 2)]) == [(1, 1), (2, 2)]


def test_steering_points(spark, plans):
    _, rig, boxes, _, runs, _ = plans
    got = plan_export.steering_points(runs.where("azimuth = 0")).orderBy("run", "seq").collect()
    assert [r.name for r in got[:3]] == ["L01S", "L01A", "L01E"] and got[0].desc == "line 1 start of run-in, steer 000°T" and got[2].desc == "line 1 recording off, turn away"
    far = planner.Rig(run_out_m=100.0)
    parted = plan_export.steering_points(planner.plan_runs(planner.plan_lines(boxes, far), far).where("azimuth = 90")).orderBy("run", "seq").collect()
    assert [r.name[3] for r in parted[:4]] == ["S", "A", "E", "T"] and parted[3].v - parted[2].v == pytest.approx(46.0) and parted[4].name != parted[0].name


@pytest.mark.parametrize("options", [{}, {"rows_of": ("targets", "marks", "routes", "track"), "turn_points": True}, {"rows_of": ("marks", "routes", "track"), "route_per_line": True}])
def test_documents_read_again_are_their_points(spark, plans, tmp_path, options):
    _, rig, _, _, runs, turns = plans
    targets = spark.createDataFrame([(0, "A & <B>", 52.5, 4.0, 60.0), (1, None, 52.51, 4.01, 45.0)], "target int, name string, lat double, lon double, radius double")
    points = plan_export.gpx_points(runs, turns, targets, 52.5, 4.0, **options).collect()
    docs = plan_export.gpx_documents(runs, turns, targets, 52.5, 4.0, rig, **options)
    gpx.write_documents(docs, str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == ["path=SEARCH 000T", "path=SEARCH 045T", "path=SEARCH 090T"]
    order = {"waypoint": 0, "route": 1, "track": 2}
    for folder in folders:
        file = [p for p in (tmp_path / "out" / folder).iterdir() if p.name.startswith("part-")]
        assert len(file) == 1
        text = file[0].read_text()
        assert "<metadata><name>SEARCH" in text and "54 m astern" in text
        mine = sorted((p for p in points if p.path == folder[5:]), key=lambda p: (order[p.kind], p.line or 0, p.seq))
        read = gpx.parse(text)
        assert [(p["kind"], p["line"], p["line_name"], p.get("name"), p.get("desc")) for p in read] == [(p.kind, p.line, p.line_name, p.name, p.desc) for p in mine]
        assert all(abs(p["lat"] - q.lat) < 1e-7 and abs(p["lon"] - q.lon) < 1e-7 for p, q in zip(read, mine))


def test_the_way_goes_from_run_to_turn_to_run(spark, plans):
    *_, runs, turns = plans
    way = [(r.v, r.u) for r in plan_export.path_points(runs.where("azimuth = 45"), turns.where("azimuth = 45")).orderBy("seq").collect()]
    legs = runs.where("azimuth = 45").orderBy("run").collect()
    assert way[0] == (legs[0].starts, legs[0].u) and way[-1] == (legs[-1].ends, legs[-1].u) and all(math.dist(a, b) > 1e-4 for a, b in zip(way, way[1:]))
    at = [way.index((x.starts, x.u)) for x in legs]
    assert at == sorted(at) and all(way[i + 1] == (x.ends, x.u) for i, x in zip(at, legs))


def test_shapes_of_every_kind(spark, plans):
    sonar, rig, boxes, lines, runs, turns = plans
    shapes = plan_export.plan_shapes(boxes, lines, runs, turns, sonar, rig)
    found = shapes.where("azimuth = 0").collect()
    kinds = {}
    for s in found:
        kinds.setdefault(s.kind, []).append(s)
    assert set(kinds) == {"box", "cover", "gap", "runin", "line", "short", "runout", "turn"}
    box = boxes.where("azimuth = 0").first()
    n = lines.where("azimuth = 0").count()
    assert len(kinds["turn"]) == n - 1 and len(kinds["line"]) == len(kinds["short"]) == n and {s.name for s in kinds["line"]} == {f"L{k + 1:02d}" for k in range(n)}
    for kind in ("cover", "gap", "line", "short"):
        assert all(box.v0 - 1e-9 <= p.v <= box.v1 + 1e-9 and box.u0 - 1e-9 <= p.u <= box.u1 + 1e-9 for s in kinds[kind] for p in s.points), kind
    for s in kinds["short"]:
        assert abs(s.points[0].v - s.points[1].v) == pytest.approx(44.0)
    seen = lambda u: any(sonar.nadir_m <= abs(u - x.u) <= sonar.range_m for x in lines.where("azimuth = 0").collect())
    middles = [(s.points[0].u + s.points[1].u) / 2 for s in kinds["gap"]]
    assert middles and not any(map(seen, middles))
    texts = [json.loads(r.geojson) for r in plan_export.plan_features(shapes, 52.5, 4.0).collect()]
    assert all(t["geometry"]["coordinates"][0][0] == t["geometry"]["coordinates"][0][-1] for t in texts if t["geometry"]["type"] == "Polygon")
    turn = next(t for t in texts if t["properties"]["kind"] == "turn")
    assert turn["geometry"]["type"] == "LineString" and isinstance(turn["properties"]["teardrop"], bool) and "name" not in turn["properties"]
