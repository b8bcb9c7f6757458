import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from seabright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, list):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if sql := registry.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(tuple(map(plain, r)) for r in got[columns].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in want[columns].itertuples(index=False))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
