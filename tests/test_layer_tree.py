import random

import pytest

from seabright.operators import layer_tree as lt

SCHEMA = "project string, place long, id string, parent string, kind string, label string, dataset string, subsystem int, visible boolean, show_fish boolean, show_boat boolean"


def layer(place, id, parent=None, kind="raster", label=None, dataset=None, subsystem=None, visible=None, fish=None, boat=None, project="p"):
    return (project, place, id, parent, kind, label or id, dataset, subsystem, visible, fish, boat)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df, project="p"):
    return [r.id for r in df.where(f"project = '{project}'").orderBy("place").collect()]


def plain_order(rows):
    known = {r[2] for r in rows}
    below = {}
    for r in sorted(rows, key=lambda r: r[1]):
        below.setdefault(r[3] if r[3] in known else None, []).append(r[2])
    out = []

    def visit(x):
        out.append(x)
        for y in below.get(x, []):
            visit(y)

    for x in below.get(None, []):
        visit(x)
    return out


def test_pre_order_of_trees_of_any_depth(spark):
    rng, rows, want = random.Random(4), [], {}
    for project in ("a", "b", "c"):
        names = [f"n{i}" for i in range(60)]
        places = rng.sample(range(1000), 60)
        mine = [layer(p, n, f"n{i - 1}" if project == "a" and i else rng.choice([None, "", "gone", *names[:i]]) if i else None, visible=rng.choice([None, True, True, False]), project=project) for i, (p, n) in enumerate(zip(places, names))]
        rows += mine
        want[project] = (plain_order(mine), {r[2]: r for r in mine})
    df = frame(spark, rows).cache()
    for project, (order, by_id) in want.items():
        assert ids(lt.normalised(df), project) == order

        def shown(i):
            return i not in by_id or by_id[i][8] is not False and shown(by_id[i][3])

        assert {r.id for r in lt.visible_layers(df).where(f"project = '{project}'").collect()} == {i for i in by_id if shown(i)}
    deep = {r.id: r for r in lt.tree(df).where("project = 'a'").collect()}
    assert deep["n59"].depth == 59 and deep["n59"].above == [f"n{i}" for i in range(59)]


def test_rings_are_reported(spark):
    df = frame(spark, [layer(0, "a", "c"), layer(1, "b", "a"), layer(2, "c", "b", visible=False), layer(3, "d", "a"), layer(4, "e"), layer(5, "f", "e"), layer(6, "g", "g")])
    assert sorted(r.id for r in lt.rings(df).collect()) == ["a", "b", "c", "d", "g"] and ids(lt.normalised(df)) == ["e", "f"]
    assert sorted(r.id for r in lt.visible_layers(df).collect()) == ["e", "f", "g"]
    assert lt.normalised(df.limit(0)).count() == 0


def test_moves_among_siblings(spark):
    rows = [layer(0, "x"), layer(1, "x1", "x"), layer(2, "x2", "x"), layer(3, "x3", "x"), layer(4, "y"), layer(5, "z"), layer(6, "z1", "z"), layer(7, "lost", "gone")]
    cases = {
        ("x", 2): (["y", "x", "x1", "x2", "x3", "z", "z1", "lost"], True), ("z", 0): (["z", "z1", "x", "x1", "x2", "x3", "y", "lost"], True), ("x1", 3): (["x", "x2", "x3", "x1", "y", "z", "z1", "lost"], True),
        ("x3", 0): (["x", "x3", "x1", "x2", "y", "z", "z1", "lost"], True), ("y", 9): (["x", "x1", "x2", "x3", "z", "z1", "lost", "y"], True),
        ("x1", 0): (None, False), ("x1", 1): (None, False), ("z1", 1): (None, False), ("lost", 0): (None, False), ("nobody", 1): (None, None), ("y", -1): (None, False),
    }
    lists = frame(spark, [(f"p{k}", *row[1:]) for k in range(len(cases)) for row in rows])
    asked = spark.createDataFrame([(f"p{k}", i, at) for k, (i, at) in enumerate(cases)], "project string, id string, at int")
    after, done = lt.moved(lists, asked).cache(), {r.project: r.moved for r in lt.moves(lists, asked).collect()}
    for k, ((i, at), (order, moves)) in enumerate(cases.items()):
        assert ids(after, f"p{k}") == (order or [r[2] for r in rows]), (i, at)
        assert done.get(f"p{k}") == moves, (i, at)


def test_removal_takes_what_is_under(spark):
    df = frame(spark, [layer(0, "x"), layer(1, "x1", "x"), layer(2, "x2", "x1"), layer(3, "y"), layer(0, "x", project="q")])
    gone = spark.createDataFrame([("p", "x"), ("p", "nobody")], "project string, id string")
    assert sorted((r.project, r.id) for r in lt.removed(df, gone).collect()) == [("p", "y"), ("q", "x")]


@pytest.mark.parametrize("have", [None, "track:d:fish"])
def test_lists_of_earlier_versions(spark, have):
    rows = [
        layer(0, "m20", kind="mosaic", label="d · ss20", dataset="d", subsystem=20), layer(1, "t20", kind="track", dataset="d", subsystem=20, fish=True, boat=False, visible=False), layer(2, "t21", kind="track", dataset="d", subsystem=21, boat=True),
        layer(3, "rec:d", kind="recording", dataset="d"), layer(4, "pic", kind="geotiff"), layer(5, "way", kind="gpx"), layer(6, "m21", kind="mosaic", label="mine", dataset="d", subsystem=21), layer(7, None), layer(8, "nokind", kind=None),
    ]
    rows += [layer(9, have, "rec:d", kind="track", dataset="d", label="kept", visible=False)] if have else []
    got = {r.id: r for r in lt.migrated(frame(spark, rows)).collect()}
    order = [i for i, _ in sorted(got.items(), key=lambda kv: kv[1].place)]
    if have:
        assert order == ["rec:d", "m20", "track:d:boat", "m21", "track:d:fish", "pic", "way"] and got[have].label == "kept" and got[have].visible is False
    else:
        assert order == ["rec:d", "m20", "track:d:fish", "track:d:boat", "m21", "pic", "way"] and (got["track:d:fish"].visible, got["track:d:fish"].show_boat, got["track:d:fish"].subsystem) == (True, False, None)
    assert got["track:d:boat"].visible is True and got["track:d:boat"].label == "boat track" and got["track:d:boat"].show_boat is True
    assert (got["m20"].label, got["m20"].parent, got["m21"].label, got["pic"].kind, got["way"].kind) == ("ss20 mosaic", "rec:d", "mine", "raster", "vector")
