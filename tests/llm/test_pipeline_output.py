import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from seabright.llm import packing


def test_last_stage_yields_the_sequences(spark, documents):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = corpus_pipeline.pack(spark, documents, "").collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for doc, text in texts.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        want = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert all(r.ids == want[r.start : r.start + r.length] for r in mine)
        assert {i for r in mine for i in range(r.start, r.start + r.length)} == set(range(len(want)))


def test_small_batches_give_the_same_pieces(spark, documents, monkeypatch):
    import pyarrow as pa

    path = P.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pylist([{"doc_id": r.doc_id, "text": r.text} for r in documents.collect()])
    whole = pa.Table.from_batches(packing._pieces(path, 256, 2, True)([batch]))
    monkeypatch.setattr(packing, "MOST_IDS", 100)
    parts = list(packing._pieces(path, 256, 2, True)([batch]))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert np.all(np.asarray(whole["length"]) == [len(x) for x in whole["ids"].to_pylist()])
