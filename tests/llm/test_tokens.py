import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seabright.llm import byte_bpe, packing, queries, token_counts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORD)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "the ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'re", "don't", "É", "e\u0301", "ß", "\u0130", "\u03a3", "12", "½", "_", "<|endoftext|>", "<|", "!", "!!", "\x1c", "\x01", "\x00", "\xa0", "\u2009", "日本", "🙂", "word", "Word.", ", ", "DON'T ", "'S", "'LL", "’", "“", "—", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(st.characters(codec="utf-8", max_codepoint=0x24F), max_size=40)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_chunk_encoder_is_the_library(text):
    assert np.frombuffer(packing.ChunkEncoder.at(WORD).encode([text])[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["DON'T panic “ok”", "IT'S 日本", "<|ENDOFTEXT|>", "x <|EndOfText|> y", "a<|endoftext|>B'S", "İ'S Σ'LL"])
def test_exact_spelling_and_contractions(text):
    assert np.frombuffer(packing.ChunkEncoder.at(WORD).encode([text])[0], "<u4").tolist() == ids(text)
    assert token_counts.MergeCounter.at(WORD).count(text) == len(ids(text))


def test_whole_table_is_the_library(spark, sf_dir):
    """The contract queries over every document of the smallest tables."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {d: ids(t) for d, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_count_tokens(spark, sf_dir).collect()}
    assert got == {d: (len(texts[d].encode()), len(i), len(i) > 2048) for d, i in want.items()}
    seen = {}
    for r in queries.op3_pack_powers_of_two(spark, sf_dir).collect():
        whole = [*want[r.doc_id], 2]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(np.asarray(whole[r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(len(i) + 1)) for d, i in want.items()}


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_heap_count_is_the_library(text):
    counter = token_counts.MergeCounter.at(WORD)
    assert counter.count(text) == counter.whole(text) == len(ids(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_segment_tree_is_the_library(text):
    bpe, want = byte_bpe.ByteBpe.at(BYTE, P.PATTERN), TIK.encode_ordinary(text)
    assert bpe.encode(text) == want and bpe.decode(want) == text.encode()
    assert bpe.digests([text])[0] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=20))
def test_pieces_in_step_are_pieces_alone(pieces):
    bpe = byte_bpe.ByteBpe.at(BYTE, P.PATTERN)
    assert bpe.encode_pieces(pieces) == [bpe.encode_piece(p) for p in pieces]


@pytest.mark.parametrize("word", ["a" * 4000, "ab" * 2000, " " * 3000, "\n" * 500, "é" * 1500])
def test_long_runs(word):
    assert byte_bpe.ByteBpe.at(BYTE, P.PATTERN).encode(word) == TIK.encode_ordinary(word)
    assert token_counts.MergeCounter.at(WORD).count(word) == len(ids(word))


def test_caches_do_not_change_results():
    small, counter = packing.ChunkEncoder(WORD, cache_entries=3), token_counts.MergeCounter(WORD, cache_entries=3)
    bpe = byte_bpe.ByteBpe(BYTE, P.PATTERN, cache_entries=3)
    for text in ("one two three four five six", "six five, four three. two one", "one one one"):
        for _ in range(2):
            assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == ids(text)
            assert counter.count(text) == len(ids(text))
            assert bpe.digests([text])[0][0] == len(TIK.encode_ordinary(text))


@given(st.integers(0, 10**6), st.integers(0, 12))
def test_binary_lengths(n, bits):
    lengths = packing.binary_lengths(n, 1 << bits)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1 << bits for x in lengths) and lengths == sorted(lengths, reverse=True)


def test_packing(documents, nothing, tmp_path):
    pieces = packing.pack_powers_of_two(documents, WORD, max_tokens=256, with_ids=True).cache()
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for doc, text in texts.items():
        want = [*ids(text), 2]
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        for r in mine:
            assert r.ids == want[r.start : r.start + r.length] and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        repeats = sum(d.doc_id == doc for d in documents.collect())
        assert sum(r.length for r in mine) == len(want) * repeats
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    assert documents.sparkSession.read.parquet(str(tmp_path / "buckets")).count() == len(rows)
    assert packing.pack_powers_of_two(nothing, WORD).count() == 0
    with pytest.raises(ValueError):
        packing.pack_powers_of_two(documents, WORD, max_tokens=100)


def test_counts(documents, nothing):
    rows = token_counts.count_tokens(documents, WORD).collect()
    assert len(rows) == documents.count()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert all(r.n_tokens == len(ids(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts.count_tokens(nothing, WORD).count() == 0


def test_round_trip(documents, nothing):
    rows = byte_bpe.round_trip_digests(documents, BYTE, P.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(rows) == documents.count()
    for r in rows:
        want = TIK.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(want), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(documents, BYTE, P.PATTERN), BYTE, P.PATTERN)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in documents.collect())
    assert byte_bpe.round_trip_digests(nothing, BYTE, P.PATTERN).count() == 0


def test_the_library_sees_each_word_once():
    encoder, seen = packing.ChunkEncoder(WORD), []
    library = encoder._library
    encoder._library = lambda text: seen.append(library(text)) or seen[-1]
    letters = np.random.default_rng(4).integers(97, 123, (180_000, 9)).astype(np.uint8)
    words = sorted({bytes(w).decode() for w in letters})
    texts = [" ".join(words[at::3]) for at in range(3)]
    out = [encoder.encode([t])[0] for t in [*texts, *texts]]
    assert out[:3] == out[3:] and sum(map(len, seen)) == sum(map(len, out[:3]))
    assert np.frombuffer(out[1][:400], "<u4").tolist() == ids(texts[1][:2000])[:100]
