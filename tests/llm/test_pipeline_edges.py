from collections import Counter

import public_tokenizers as P
import pytest
from test_near_copies import plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from seabright.llm import packing, pii, pii_tagger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, low double, row string, component long, keep boolean, length long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Nulls in every column, empty and repeated rows, a very long text, near copies, and columns named like those that stages make."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix nine jars of bright liquid gold in quiet halls of old stone near the river bank at noon".split()
    near = [" ".join(base), " ".join([*base[:-1], "dusk"]), " ".join(base) + " again"]
    texts = [*near, None, "", "  ", near[0], "call (212) 555-0187 or +1 (988) 555-2485 today", "mail joe@mail.example.com", "word, " * 60_000, "only one", "日本語 “quoted” DON'T <|ENDOFTEXT|>"]
    rows = [(i if i != 8 else None, t, "en" if i % 3 else None, None, i, 1.0, "x", 5, i % 2 == 0, 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[10]]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_run_is_the_plain_pipeline(spark, tables):
    """Without trusted documents the first stage keeps all that has text; the others by plain scripts over all rows."""
    folder, rows = tables
    kept = [(i, t) for i, t, *_ in rows if t]
    component, best = plain_components([t for _, t in kept]), {}
    for (i, t), c in zip(kept, component, strict=True):
        if c not in best or (i is None, i) < (best[c][0] is None, best[c][0]):
            best[c] = (i, t)
    library, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    tagger = pii_tagger.fitted()
    for i, t in best.values():
        ((_, spans),) = pii.find_spans([t], tagger)
        ids, start = [*library.encode(pii.redacted(t, spans), add_special_tokens=False).ids, 2], 0
        for length in packing.binary_lengths(len(ids), 4096):
            want[i, start, tuple(ids[start : start + length])] += 1
            start += length
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got)


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    folder, rows = tables
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
