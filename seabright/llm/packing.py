"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of ``max_tokens`` as fit and then into the powers of two of
the remainder, longest first. Each piece is a training sequence of its own, so none crosses documents and none is padded;
sequences of one length form a bucket from which batches are drawn.

Scaling: no shuffle. Every document is cut where it is read. Tokenising goes by white-space chunk: the
library encodes a chunk once, and a document's ids are the joined bytes of its chunks' ids.

Edge cases: null texts are empty, and an empty document is the end token alone (one piece of length 1). Repeated rows and ids each
give their own pieces; null ids are kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import release_memory

#: White space for str.split() but ordinary characters for the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Stands alone between chunks that are encoded together.
MARK = "\x01"
#: The blanks between chunks, and the words of chunks as the tokenizer splits them.
WORDS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: No token's id: stands for a blank while ids of many chunks are joined.
BETWEEN = b"\xff\xff\xff\xff"
#: Most bytes of ids in a batch of pieces, but for a single longer document.
MOST_IDS = 4_000_000
#: Bytes of text that are split at once: each chunk is a Python string of some 60 bytes meanwhile.
AT_ONCE = 2_000_000
#: Characters that are split by the pattern above; chunks with others are left to the library.
PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
ALL_PLAIN = re.compile(r"[ -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


class ChunkEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, equal to the library's on the whole text.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its white-space chunks in order.
    Chunks and words are kept with their ids; those not yet known are encoded many at a time. A cache of over ``cache_entries`` is emptied before the next call.
    """

    _of: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str, cache_entries: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_entries, self.known, self.words = cache_entries, {}, {" ": BETWEEN}
        self.mark = self._library(MARK)
        #: Whether a token of an id ends a word; None where the model does not tell.
        self.ends = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def at(cls, path: str) -> ChunkEncoder:
        """One encoder a process: workers that run several tasks load the tokenizer once."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def forget(self) -> None:
        """Empty the caches, so that an idle worker holds no more than the tokenizer."""
        self.known, self.words = {}, {" ": BETWEEN}
        release_memory()

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn_words(self, words: list[str], single: bool) -> dict[str, bytes]:
        """Ids of distinct words that hold neither white space nor the mark, many to a call. ``single``: each is one word to the library too, whose last token tells its end."""
        out, told = {}, single and self.ends is not None
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            raw = self._library((" " if told else f" {MARK} ").join(part))
            ids = np.frombuffer(raw, "<u4")
            if told:
                ends = np.flatnonzero(self.ends[ids]) + 1
                begins = np.append(0, ends[:-1])
            else:
                ends = np.append(np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0]), len(ids))
                begins = np.append(0, ends[:-1] + 1)
            assert len(ends) == len(part)
            out.update(zip(part, [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)], strict=True))
        return out

    def _learn(self, chunks: set[str]) -> None:
        plain, text = list(chunks), " ".join(chunks)
        whole, other = set(), set()
        if "<|" in text or not ALL_PLAIN.fullmatch(text):
            whole = {c for c in chunks if "<|" in c or MARK in c}
            plain = [c for c in chunks if PLAIN.fullmatch(c) and c not in whole]
            other = chunks.difference(whole, plain)  # each is a word to the library
            text = " ".join(plain)
        tokens = WORDS.findall(text.lower())  # lower case is one character for one here
        words = self.words
        if len(words) > self.cache_entries:
            words = self.words = {" ": BETWEEN}
        words.update(self._learn_words([w for w in set(tokens) if w not in words], True))
        raw = b"".join(map(words.__getitem__, tokens))
        ends = [*(4 * np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(BETWEEN, "<u4")[0])).tolist(), len(raw)]
        self.known.update(zip(plain, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)], strict=False))
        self.known.update(self._learn_words(list(other), False))
        self.known.update((c, self._library(c)) for c in whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the caller passes about as much text as may be split at once."""
        split = [None if ODD_SPACE.search(t) else _lower(t).split() for t in texts]
        if len(self.known) > self.cache_entries:
            self.known = {}
        known = self.known
        self._learn(set(filterfalse(known.__contains__, chain.from_iterable(s for s in split if s))))
        get = known.__getitem__
        return [self._library(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


def _lower(text: str) -> str:
    """Lower case, so that more chunks are equal, where the tokenizer does that first: no special strings, which it cuts out
    before; one character for one, composed already."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def text_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 8_000_000):
    """Runs of rows of about ``most_bytes`` of text each, so that memory does not follow the batch size."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, total = 0, np.cumsum(sizes)
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def binary_lengths(n: int, most: int) -> list[int]:
    """n as multiples of ``most`` (a power of two) and then falling powers of two."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, most: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def cut(doc_id: pa.Array, first: int, encoded: list[bytes]) -> pa.RecordBatch:
        columns = [[] for _ in range(5)]
        for row, raw in enumerate(encoded, first):
            raw += end
            n, start = len(raw) // 4, 0
            for length in binary_lengths(n, most):
                for c, v in zip(columns, (row, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n), strict=True):
                    c.append(v)
                start += length
        rows, *rest = columns
        arrays = [doc_id.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:  # pieces follow one another as the ids do
            ids = np.frombuffer(b"".join(x for raw in encoded for x in (raw, end)), "<i4")
            arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rest[1])), pa.int32()), pa.array(ids)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        encoder = ChunkEncoder.at(path)
        try:
            for batch in batches:
                for part in text_slices(batch, most_bytes=AT_ONCE):
                    encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                    begin = 0
                    while begin < len(encoded):  # as many rows at once as hold about MOST_IDS bytes of ids
                        rows, size = begin, 0
                        while rows < len(encoded) and (rows == begin or size + len(encoded[rows]) <= MOST_IDS):
                            size += len(encoded[rows])
                            rows += 1
                        yield cut(part.column("doc_id"), begin, encoded[begin:rows])
                        begin = rows
        finally:
            encoder.forget()

    return run


def pack_powers_of_two(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    ``tokenizer`` is the path of a tokenizers file that drops white space; ``max_tokens`` a power of two.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError(f"max_tokens must be a power of two: {max_tokens}")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, max_tokens, end_id, with_ids), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length, for loaders that draw batches of equal lengths."""
    pieces.write.partitionBy("length").parquet(path)
