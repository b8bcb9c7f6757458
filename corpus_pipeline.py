"""The corpus pipeline: quality filter, near-duplicate removal, removal of personal data, packing.

Each stage works on all that the one before kept. ``run`` writes each stage's result to the shared folder and reads it again, so
a lost executor costs at most a part of one stage. Every stage but the last returns the columns it was given, whatever others there are and however they are named;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seabright.llm import near_copies, packing, pii, quality_lm, queries
from seabright.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model accepts. Null and empty texts go; null ids and languages are judged like others; each of a document's repeats is judged alike; texts of any length are read whole."""
    return quality_lm.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of runs of five words: the least id, null ids last. Repeated rows are one group; texts without words are one group."""
    return near_copies.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by the names of its kinds; null texts stay null, repeated rows stay repeated."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two tokens, with their token ids; those of one length are a bucket. A null or empty text is the end token alone; null ids and repeated rows give pieces of their own."""
    return packing.pack_powers_of_two(docs, queries.tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: SQL can express neither the model nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
