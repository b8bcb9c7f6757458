import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seabright.llm import cross_polytope, topk_threshold

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.0) for i, v in rows], SCHEMA)


def brute(rows, k, score):
    out = {}
    for q, a in rows:
        if q % 5 == 0:
            best = {}
            for c, b in rows:
                if c != q:
                    best[c] = max(best.get(c, -np.inf), score(a, b))
            out.setdefault(q, []).extend(best.items())
    return {q: sorted(set(x), key=lambda t: (-t[1], t[0]))[:k] for q, x in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def whole(a, b):
    return int((np.floor(256 * np.float32(a).astype(float)) * np.floor(256 * np.float32(b).astype(float))).sum())


BAD = [(1000, None), (1005, [1.0, None]), (1010, [float("nan"), 1.0]), (1015, [float("inf"), 0.0]), (None, [1.0, 2.0])]


@pytest.mark.parametrize("spread", ["normal", "copies", "integers"])
def test_threshold_algorithm_is_exact(spark, spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) if spread == "normal" else rng.integers(-2, 3, (300, 6)) / 4
    if spread == "copies":
        x[50:200] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = topk_threshold.threshold_top_k(make(spark, rows + BAD), F.col("vec_id") % 5 == 0, block_rows=70)
    assert found(got) == brute(rows, 5, whole)


def test_threshold_small(spark):
    query = F.col("vec_id") % 5 == 0
    assert topk_threshold.threshold_top_k(make(spark, []), query).count() == 0
    assert found(topk_threshold.threshold_top_k(make(spark, [(0, [1.0]), (1, [0.5]), (2, [0.5])]), query)) == {0: [(1, 256 * 128), (2, 256 * 128)]}
    assert found(topk_threshold.threshold_top_k(make(spark, [(0, [0.0, 0.0]), (3, [1.0, 0.0]), (2, [0.5, 9.0])]), query)) == {0: [(2, 0), (3, 0)]}
    repeated = [(0, [1.0]), (1, [0.5]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    assert found(topk_threshold.threshold_top_k(make(spark, repeated), query)) == {0: [(1, 256 * 512), (2, 256 * 256)]}


def test_threshold_stops_early():
    rows = np.zeros((1000, 4))
    rows[:, 0] = np.arange(1000)
    lists = topk_threshold.SortedLists(rows, np.arange(1000))
    scores, ids = lists.top(np.array([1.0, 0, 0, 0]), -1, 3, first_depth=8)
    assert ids.tolist() == [999, 998, 997] and scores.tolist() == [999, 998, 997]


def test_threshold_overflow_and_floor(spark):
    with pytest.raises(Exception, match="64 bits"):
        topk_threshold.threshold_top_k(make(spark, [(0, [1e16, 1.0]), (1, [1e16, 1.0])]), F.col("vec_id") % 5 == 0).collect()
    rows = np.arange(40, dtype=float).reshape(20, 2)
    lists = topk_threshold.SortedLists(rows, np.arange(20))
    assert lists.top(np.array([1.0, 1.0]), -1, 2, floor=78)[1].tolist() == []  # the best possible is 77
    assert lists.top(np.array([1.0, 1.0]), -1, 2, floor=77)[1].tolist()[0] == 19


def cosine(a, b):
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(10, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.rotate(x, 3, 1), axis=1), np.linalg.norm(x, axis=1))
    near = np.argsort(-cross_polytope.signed_axes(x, 3, 1), axis=1)
    assert all(sorted(r) == list(range(32)) for r in near.tolist())
    assert (np.abs(near[:, 0] - near[:, -1]) == 16).all()  # the farthest axis is the nearest one's opposite


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_probes_are_the_best_buckets(depth):
    x = np.random.default_rng(1).normal(size=(20, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    group, last = cross_polytope.buckets(x, 4, depth, 9, 12)
    axes = [cross_polytope.signed_axes(x, 4 * 64 + i, 9) for i in range(depth)]
    for row in range(20):
        loss = {}
        for combo in np.ndindex(*(16,) * depth):
            g = 0
            for c in combo[:-1]:
                g = g * 16 + c
            loss[g, combo[-1]] = sum((axes[i][row].max() - axes[i][row][c]) ** 2 for i, c in enumerate(combo))
        got = [loss[g, c] for g, c in zip(group[row].tolist(), last[row].tolist(), strict=True)]
        assert np.allclose(got, sorted(loss.values())[:12]) and len(set(zip(group[row], last[row]))) == 12


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_cross_polytope_recall_on_the_table(spark, sf_dir, scale):
    path = sf_dir.replace("sf0.001", scale) + "/embeddings.parquet"
    table = spark.read.parquet(path)
    got = found(cross_polytope.cross_polytope_top_k(table, F.col("vec_id") % 50 == 0))
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect() if r.vec_id is not None and r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[at]
        s[ids == ids[at]] = -9
        fifth = np.sort(s)[-5]
        assert len(got[ids[at]]) == 5
        hits += sum(score >= fifth - 1e-9 for _, score in got[ids[at]])
        total += 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("copies", [False, True])
def test_cross_polytope_recall(spark, copies):
    x = np.random.default_rng(7).normal(size=(2000, 32))
    if copies:
        x[300:1000] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    extra = BAD + [(1020, [0.0] * 32)] if not copies else []
    vectors = make(spark, [(i + 5000 if i is not None else None, v) for i, v in extra] + rows)
    got = found(cross_polytope.cross_polytope_top_k(vectors, F.col("vec_id") % 50 == 0, block_rows=200))
    unit = np.float32(x).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 2000, 50):
        s = unit @ unit[q]
        s[q] = -9
        if copies and 300 <= q < 1000:  # a copy's nearest are the other copies of least id, at a cosine of one
            want = [i for i in range(300, 306) if i != q][:5]
            assert [i for i, _ in got[q]] == want
            continue
        want = set(np.lexsort((np.arange(2000), -s.round(12)))[:5].tolist())
        hits += len(want & {i for i, _ in got[q]})
        total += 5
        assert all(abs(v - s[i]) < 1e-12 for i, v in got[q])
    assert hits / total >= 0.9


def test_cross_polytope_small(spark):
    query = F.col("vec_id") % 5 == 0
    assert cross_polytope.cross_polytope_top_k(make(spark, []), query).count() == 0
    got = found(cross_polytope.cross_polytope_top_k(make(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]), query))
    assert [i for i, _ in got[0]] == [1, 2]
    apart = make(spark, [(0, [1.0, 0.0, 0.0, 0.0]), (1, [-1.0, 0.1, 0.0, 0.0]), (2, [0.0, -1.0, 0.3, 0.0]), (3, [0.0, 0.0, 0.0])])
    got = found(cross_polytope.cross_polytope_top_k(apart, query, probes=1, tables=1))  # no bucket in common: all rows are compared
    assert [i for i, _ in got[0]] == [2, 1]
    assert abs(got[0][1][1] - cosine([1.0, 0.0], [-1.0, 0.1])) < 1e-12


def test_cross_polytope_does_not_depend_on_the_number_of_rows(spark):
    rng = np.random.default_rng(11)
    near, far = np.zeros((300, 64)), np.zeros((3000, 64))
    near[:, :32], far[:, 32:] = rng.normal(size=(300, 32)), rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    more = [(5 * i + 1001, v.tolist()) for i, v in enumerate(far)]  # at right angles to all of the others; no queries
    alone, among = (found(cross_polytope.cross_polytope_top_k(make(spark, x), F.col("vec_id") % 5 == 0)) for x in (rows, rows + more))
    assert len(alone) == 60 and among == alone


def test_a_cell_returns_the_best_of_all_last_hashes():
    rng = np.random.default_rng(2)
    rows, own = rng.integers(-127, 128, (300, 8)).astype(np.int8), rng.integers(-127, 128, (2, 8)).astype(np.int8)
    stored = pa.table({"id": pa.array(range(300), pa.int64()), "small": [v.tobytes() for v in rows], "last": pa.array(np.arange(300) % 3, pa.int32())})
    asked = lambda floor: pa.table({"id": pa.array([1000, 1001], pa.int64()), "small": [v.tobytes() for v in own], "lasts": pa.array([[0, 1, 2], [1]], pa.list_(pa.int32())), "floor": pa.array(floor, pa.float32())})
    a, b = own.astype(float), rows.astype(float)
    score = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
    score[1, np.arange(300) % 3 != 1] = -9
    got = cross_polytope._met(24)(asked([None, None]), stored).to_pydict()
    for q in (0, 1):
        assert [v for i, v in zip(got["query_id"], got["vec_id"], strict=True) if i == 1000 + q] == np.argsort(-score[q])[:24].tolist()
    floor = np.sort(score[0])[-10] - 1e-6
    got = cross_polytope._met(24)(asked([floor, 2.0]), stored).to_pydict()
    assert got["query_id"] == [1000] * 10 and got["vec_id"] == np.argsort(-score[0])[:10].tolist()


def test_buckets_within_a_loss_are_all_of_them():
    x = np.random.default_rng(3).normal(size=(10, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = [cross_polytope.signed_axes(x, 64 + i, 9) for i in range(2)]
    losses = [(y.max(axis=1)[:, None] - y) ** 2 for y in near]
    whole = losses[0][:, :, None] + losses[1][:, None, :]
    most = np.quantile(whole.reshape(10, -1), 0.2, axis=1)
    row, group, last, over = cross_polytope.buckets_within(near, most, 1000)
    assert np.array_equal(np.stack([row, group, last]), np.stack(np.nonzero(whole <= most[:, None, None]))) and not over.any()
    assert cross_polytope.buckets_within(near, most, 5)[3].all()
    assert (cross_polytope.losses_of_neighbours(near, np.ones(10), 7, 1, 9) == 0).all()  # the vector itself is in its best bucket
