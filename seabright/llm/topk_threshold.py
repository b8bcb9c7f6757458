"""Exact top-k inner-product search by Fagin's threshold algorithm.

Candidates are hashed into blocks of about ``block_rows``; a block keeps, per dimension, its rows sorted by that
component, once for all queries. A query walks the lists of its non-zero components from their better end (the largest values
for a positive weight, the smallest for a negative one), scores each row on first sight, and stops as soon as
the sum of the list frontiers, the best any unseen row could score, is below its kth score. All queries go through one block first; the kth score
they find there is their floor in all others, which may stop at once.

Scaling: rows are shuffled once; only queries are sent to every block, and each block returns k rows a query. A task holds one block and streams queries past it, so no task
holds more than ``block_rows`` rows whatever the data look like. An exact search has to compare every query with every block; on vectors of many like dimensions the frontiers
fall slowly, and most rows of a block are scored (all of them on the uniform vectors of the test tables).

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids. Shorter vectors
count as padded with zeros. Repeated ids count once, with their best score. Ties go to the smaller id.
Fewer than k candidates: all are returned. Components beyond 2**62 / width / the largest component would overflow and are an error. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.llm.common import finite_vector, materialize

FOUND = "query_id long, vec_id long, score long"


def matrix(vectors: pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros to ``width``."""
    lists = vectors.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=dtype)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def width_of(*columns: pa.ChunkedArray) -> int:
    """The longest list."""
    return max(int(np.diff(np.asarray(chunk.offsets)).max(initial=0)) for c in columns for chunk in c.chunks)


class SortedLists:
    """The per-dimension sorted lists of a block of rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()  # dimension x rank, ascending
        self.values = np.take_along_axis(rows, self.order.T, axis=0).T.copy()

    def top(self, query: np.ndarray, own: int, k: int, first_depth: int = 64, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows, best first, ties to the smaller id; and never ``own``. Rows below ``floor`` need not be found."""
        n = len(self.ids)
        scores, ids = np.empty(0), np.empty(0, np.int64)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        if not len(up) and not len(down):  # every row scores zero
            ids = np.unique(self.ids[self.ids != own])[:k]
            return np.zeros(len(ids)), ids
        depth, step = 0, first_depth
        if self.values[up, n - 1] @ query[up] + self.values[down, 0] @ query[down] < floor:
            return scores, ids
        while depth < n:
            reach = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - reach : n - depth].ravel()] = True
            met[self.order[down, depth:reach].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            got = self.rows[fresh] @ query
            if len(scores) == k:
                good = got >= scores[-1]
                fresh, got = fresh[good], got[good]
            new = self.ids[fresh]
            scores, ids = _best(np.concatenate([scores, got[new != own]]), np.concatenate([ids, new[new != own]]), k)
            bound = self.values[up, n - reach] @ query[up] + self.values[down, reach - 1] @ query[down]
            if bound < floor or len(scores) == k and scores[-1] > bound:
                break
            depth, step = reach, step * 2
        return scores, ids


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 64 * k:  # a cut that keeps every row that ties with the last place, unless ids repeat
        if len(np.unique(ids)) == len(ids):
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return scores[first], ids[first]


def exact_dtype(width: int, *parts: np.ndarray):
    """The cheapest type in which inner products of these integers are exact."""
    most = width * math.prod(max(-int(p.min(initial=0)), int(p.max(initial=0))) for p in parts)
    if most >= 2**63:
        raise OverflowError("inner products of such components do not fit 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _blocks(k: int, at_once: int = 4096):
    """For mapInArrow over rows sorted by block and then candidates before queries: the k best of each block for each of its queries."""

    def searched(rows: np.ndarray, ids: np.ndarray, lists: dict, queries: pa.Table):
        width = max(1, rows.shape[1], width_of(queries["vec"]))
        q = matrix(queries["vec"], width, np.int64)
        kind = exact_dtype(width, q, rows)
        if lists.get("kind") != (kind, width):
            wide = np.zeros((len(rows), width), kind)
            wide[:, : rows.shape[1]] = rows
            lists.update(kind=(kind, width), lists=SortedLists(wide, ids))
        floors = [-math.inf if f is None else f for f in queries["floor"].to_pylist()]
        out = [(own, *lists["lists"].top(v, own, k, floor=f)) for own, v, f in zip(queries["id"].to_pylist(), q.astype(kind), floors, strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([o for o, _, _ in out], [len(i) for _, _, i in out]), pa.int64()),
            pa.array(np.concatenate([i for _, _, i in out]), pa.int64()),
            pa.array(np.concatenate([s for _, s, _ in out]).astype(np.int64), pa.int64()),
        ], ["query_id", "vec_id", "score"])

    def run(batches):
        block, held, rows, ids, lists = None, [], None, None, {}
        for batch in batches:
            names = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if names[a] != block:
                    block, held, rows, lists = names[a], [], None, {}
                asks = int(np.searchsorted(part.column("asks").to_numpy(zero_copy_only=False), True))
                if asks:
                    held.append(part.slice(0, asks).select(["id", "vec"]))
                if asks < part.num_rows and held:
                    if rows is None:
                        t = pa.Table.from_batches(held)
                        rows, ids, held = matrix(t["vec"], max(1, width_of(t["vec"])), np.int64), t["id"].to_numpy(), [None]
                    queries = pa.Table.from_batches([part.slice(asks)])
                    for at in range(0, queries.num_rows, at_once):
                        yield searched(rows, ids, lists, queries.slice(at, at_once))

    return run


def rank_found(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct (query_id, vec_id) rows of each query, with their ranks."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def threshold_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) for each row where ``is_query`` holds."""
    valid = vectors.where(F.col(id_col).isNotNull() & finite_vector(F.col(vector_col)))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    rows = valid.select(F.col(id_col).cast("long").alias("id"), whole.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    stored = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("floor"))

    def search(queries: DataFrame, kept: DataFrame) -> DataFrame:
        both = kept.unionByName(queries.select("id", "vec", "block", F.lit(True).alias("asks"), "floor"))
        return both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(_blocks(k), FOUND)

    asked = rows.where("is_query").select("id", "vec")
    first = search(asked.withColumns({"block": F.lit(0).cast("long"), "floor": F.lit(None).cast("long")}), stored.where("block = 0"))
    if blocks == 1:
        return rank_found(first, k)
    first = materialize(rank_found(first, k), "first-block")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    others = asked.join(floors, "id", "left").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks - 1).cast("long"))))
    return rank_found(first.select("query_id", "vec_id", "score").unionByName(search(others, stored.where("block > 0"))), k)
