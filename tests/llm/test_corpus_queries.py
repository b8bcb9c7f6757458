import numbers

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from seabright.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    number = lambda v: isinstance(v, numbers.Number) and not isinstance(v, bool)  # noqa: E731  columns with nulls hold floats on one side
    rows = lambda df: sorted(tuple(str(None if pd.isna(v) else float(v) if number(v) else v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left and docs.select("doc_id").distinct().count() == docs.count()
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == left
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
