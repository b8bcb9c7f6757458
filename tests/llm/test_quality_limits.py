from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seabright.llm import quality_lm


def test_limits_keep_clean_and_few_bad_documents(spark):
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_lm.judge_quality(docs, labels).join(labels, "doc_id").where("quality = 0 or coalesce(toxic, 0) <> 1")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("kept")).collect()}
    assert kept[1] >= 0.99 and kept[0] <= 0.07
