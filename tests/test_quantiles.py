import math

import numpy as np
import pytest

from seabright.operators import quantiles as q


def columns():
    rng = np.random.default_rng(2)
    odd = [0.0, -0.0, 1e308, -1e308, 5e-324, -5e-324, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, 2.0, 2 - 2**-52]
    return {
        "even": rng.random(3000), "ties": rng.integers(0, 5, 3000).astype(float), "one": np.full(500, 7.25), "powers": np.ldexp(rng.random(2000) - 0.5, rng.integers(-1000, 1000, 2000)),
        "near": 1 + np.arange(2000) * 2.0**-52, "odd": np.array(odd * 30), "short": np.array([3.0]), "two": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize("enough", [10, 100_000])
def test_each_group_has_the_values_of_a_sort(spark, enough):
    made = columns()
    rows = [(k, float(v)) for k, values in made.items() for v in values] + [("even", None), ("even", math.nan), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3).cache()
    shares = {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p98": 0.98, "p100": 1.0}
    for rule in ("nearest", "upper"):
        got = {r.g: r for r in q.quantiles(df, "v", shares, "g", rule=rule, enough=enough).collect()}
        assert set(got) == set(made)
        for name, values in made.items():
            s = np.sort(values)
            at = [math.floor((len(s) - 1) * p + 0.5) if rule == "nearest" else min(math.floor(len(s) * p), len(s) - 1) for p in shares.values()]
            assert [got[name][k] for k in shares] == [s[i] for i in at], (name, rule)
    plain = {k: v for k, v in made.items() if k != "odd"}
    got = {r.g: r for r in q.quantiles(df, "v", shares, "g", enough=enough).collect()}
    for name, values in plain.items():
        assert np.allclose([got[name][k] for k in shares], np.quantile(values, list(shares.values())), rtol=1e-12), name


def test_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1000, 0, -1)], "v double")
    assert q.quantiles(df, "v", {"m": 0.5}, enough=20).first().m == 500.5
    assert q.quantiles(df, "v", {"m": 0.5}, rule="upper", enough=20).first().m == 501
    assert q.quantiles(df.limit(0), "v", {"m": 0.5}).collect()[0].m is None
    with pytest.raises(ValueError):
        q.quantiles(df, "v", {"m": 0.5}, rule="other")


@pytest.mark.parametrize("name", ["stretched_grey", "quantile_conventions"])
def test_queries_of_quantiles_hold_no_column_in_a_task(spark, name):
    from seabright.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_curves_of_the_gain_lookup_go_to_the_samples(spark):
    """Two sides would be two tasks for all samples."""
    from seabright.plans import registry

    plan = registry.QUERIES["angle_gain_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
