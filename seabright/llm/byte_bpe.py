"""Byte-level BPE encoding and decoding with a segment tree.

A piece's leaves are its byte positions; each holds the rank of the pair that begins there, or none. Inner nodes hold
the leftmost minimum of their leaves, so the root names the next merge. A merge updates three leaves (the merged
position, its live predecessor, and its swallowed successor), each in logarithmic time; live neighbours are linked.

Texts are split by the vocabulary's pattern; pieces are encoded apart and kept in a bounded cache by chunk, where a chunk is a
stretch that the pattern provably never crosses: single spaces and line feeds between other characters.

Scaling: no shuffle; a document is one row in, one row out.

Edge cases: null and empty texts have no ids; their digests are those of empty strings. Repeated rows and null ids give a row each.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import TwoGenerations
from seabright.llm.packing import text_slices

NONE = 1 << 62
PLACE = 32


class SegmentTree:
    """Leftmost minimum over ranks; a node's value is rank << PLACE | position."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, (len(ranks) - 1).bit_length())
        leaves = [NONE if r < 0 else r << PLACE | i for i, r in enumerate(ranks)]
        self.node = node = [NONE] * size + leaves + [NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def update(self, at: int, rank: int) -> None:
        node, i = self.node, at + self.size
        node[i] = NONE if rank < 0 else rank << PLACE | at
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a < b else b
            if node[i] == least:
                break
            node[i] = least
            i >>= 1


class SegmentTrees:
    """As many segment trees as there are pieces, of one size, updated in step: node[i] holds node i of every tree."""

    def __init__(self, ranks: np.ndarray):
        self.size, n = ranks.shape
        place = np.arange(self.size, dtype=np.int64)[:, None]
        self.node = np.full((2 * self.size, n), NONE, np.int64)
        self.node[self.size :] = np.where(ranks < 0, NONE, ranks << PLACE | place)
        for i in range(self.size - 1, 0, -1):
            np.minimum(self.node[2 * i], self.node[2 * i + 1], out=self.node[i])

    def update(self, tree: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """One leaf of each of some trees."""
        i, node = at + self.size, self.node
        node[i, tree] = np.where(rank < 0, NONE, rank << PLACE | at)
        for _ in range(self.size.bit_length() - 1):
            i >>= 1
            node[i, tree] = np.minimum(node[2 * i, tree], node[2 * i + 1, tree])


class ByteBpe:
    """Encoder and decoder for a file of ranks, one base64 token and its rank a line."""

    _of: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, path: str, pattern: str, cache_entries: int = 250_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.known, self.pieces = TwoGenerations(cache_entries), TwoGenerations(cache_entries)
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                if (a := self.rank.get(token[:cut])) is not None and (b := self.rank.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = r
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], NONE), np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)

    @classmethod
    def at(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._of:
            cls._of[path, pattern] = cls(path, pattern)
        return cls._of[path, pattern]

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return [whole]
        n = len(piece)
        tree = SegmentTree([rank.get(piece[i : i + 2], -1) for i in range(n - 1)])
        node, update = tree.node, tree.update
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := node[1]) != NONE:
            i = least & ((1 << PLACE) - 1)
            j = after[i]
            k = after[i] = after[j]
            end = n
            if k < n:
                before[k], end = i, after[k]
                update(i, rank.get(piece[i:end], -1))
            else:
                update(i, -1)
            if j < n - 1:
                update(j, -1)
            h = before[i]
            if h >= 0:
                update(h, rank.get(piece[h:k], -1))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, -1 for none."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """``encode_piece`` of many pieces; short ones go in step, by size."""
        out: list[list[int]] = [None] * len(pieces)
        short: dict[int, list[int]] = {8: [], 16: [], 32: []}
        for at, piece in enumerate(pieces):
            if (whole := self.rank.get(piece)) is not None:
                out[at] = [whole]
            elif (n := len(piece)) <= 32:
                short[8 if n <= 8 else 16 if n <= 16 else 32].append(at)
            else:
                out[at] = self.encode_piece(piece)
        for size, ats in short.items():
            for begin in range(0, len(ats), 20_000):
                part = ats[begin : begin + 20_000]
                for at, ids in zip(part, self._in_step([pieces[i] for i in part], size), strict=True):
                    out[at] = ids
        return out

    def _in_step(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Pieces of at most ``size`` bytes: each round does the next merge of every piece that has one left."""
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(count, size).T
        place = np.arange(size, dtype=np.int64)[:, None]
        token = np.where(place < lengths, self.byte_rank[raw], -1)  # of the token that begins there; -1: swallowed or beyond the end
        token = np.vstack([token, np.full((1, count), -1)])
        rank = np.full((size, count), -1, np.int64)
        rank[:-1] = np.where(place[1:] < lengths, self._pair_rank(token[: size - 1], np.maximum(token[1:size], 0)), -1)
        after = np.minimum(place + 1, lengths) + np.zeros((1, count), np.int64)
        before = np.vstack([place - 1 + np.zeros((1, count), np.int64), np.zeros((1, count), np.int64)])
        trees = SegmentTrees(rank)
        live = np.flatnonzero(trees.node[1] != NONE)
        while len(live):
            least = trees.node[1, live]
            i = least & ((1 << PLACE) - 1)
            j = after[i, live]
            k = after[j, live]
            token[i, live], token[j, live] = least >> PLACE, -1
            after[i, live], before[k, live] = k, i
            inside = k < lengths[live]
            ahead = np.where(inside, self._pair_rank(token[i, live], np.where(inside, token[k, live], 0)), -1)
            trees.update(live, i, ahead)
            trees.update(live, j, np.full(len(live), -1, np.int64))
            h = before[i, live]
            some = np.flatnonzero(h >= 0)
            trees.update(live[some], h[some], self._pair_rank(token[h[some], live[some]], token[i[some], live[some]]))
            live = live[trees.node[1, live] != NONE]
        token = token[:size].T
        kept = token >= 0
        flat, ends = token[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])

    def _cut(self, chunk: str) -> list[str] | None:
        """A chunk's pieces; None for one that white space may join to its neighbours."""
        core = chunk[1:] if chunk[0] in " \n" and len(chunk) > 1 else chunk
        if core.isascii():
            if core.isalpha():
                return [chunk]
            if core[:-1].isalpha() and core[-1] in ".,;:!?":
                return [chunk[:-1], core[-1]]
        if chunk != "\n" and (core[:1].isspace() or core[-1:].isspace()):
            return None
        return self.pattern.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Keep each chunk's count, ids as text, and decoded bytes, or None."""
        cut = {c: self._cut(c) if c else None for c in chunks}
        needed = {p for ps in cut.values() if ps for p in ps}
        unknown = self.pieces.unknown(needed)
        got = {p: self.pieces[p] for p in needed - unknown}
        unknown = list(unknown)
        for piece, ids in zip(unknown, self.encode_pieces([p.encode() for p in unknown]), strict=True):
            got[piece] = value = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            self.pieces.put(piece, value)
        for c, ps in cut.items():
            if ps is None:
                self.known[c] = None
            elif len(ps) == 1:
                self.known[c] = got[ps[0]]
            else:
                n, shown, raw = zip(*[got[p] for p in ps], strict=True)
                self.known[c] = sum(n), " ".join(shown), b"".join(raw)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the decoded bytes."""
        split = [None if not t or "\0" in t else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") for t in texts]
        distinct = set().union(*(s for s in split if s))
        known = self.known
        if len(known) + len(distinct) > known.limit:
            known.old = dict(known)
            known.clear()
        self.learn(known.unknown(distinct))
        return [self._digest(t, None if s is None else list(map(known.__getitem__, s))) for t, s in zip(texts, split, strict=True)]

    def _digest(self, text: str, parts: list | None) -> tuple[int, str, str]:
        if parts is None or None in parts:
            ids = self.encode(text)
            return len(ids), _sha(" ".join(map(str, ids)).encode()), _sha(self.decode(ids))
        counts, shown, raw = zip(*parts, strict=True)
        return sum(counts), _sha(" ".join(shown).encode()), _sha(b"".join(raw))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""

    def run(batches):
        bpe = ByteBpe.at(ranks, pattern)
        for batch in batches:
            got = [d for part in text_slices(batch) for d in bpe.digests([t or "" for t in part.column("text").to_pylist()])]
            n, ids, raw = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids of every document."""

    def run(batches):
        bpe = ByteBpe.at(ranks, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); bytes that are not UTF-8 are replaced."""

    def run(batches):
        bpe = ByteBpe.at(ranks, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
