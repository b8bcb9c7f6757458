"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A hash is a fast pseudo-rotation, three rounds of random signs and a Walsh-Hadamard transform,
followed by the nearest signed axis: 2 * dim values. A table's bucket is the concatenation of ``depth`` hashes. Rows are stored under their own bucket of
each table; a query also probes the buckets whose axes are nearly as near. What it meets is scored from bytes (vectors scaled to 127), and the best ``KEPT`` are reranked by
the exact cosine.

How many buckets a query probes follows from what it meets, never from the number of rows. First it opens the ``FIRST`` best of each table. The k-th best cosine found there says how far its neighbours are: random vectors
at that cosine are hashed, and every bucket is opened whose loss is within the quantile of theirs that finds a neighbour in some table with a chance of ``SURE``. Real neighbours are nearer
than those first met, so recall is higher than that. A query that would open over ``MOST_PROBES`` buckets of a table, or met fewer than k rows, is compared with all rows, in blocks.

Scaling: rows and queries meet by table and all hashes but the last, as vectors of one byte a component; a query is sent there once with its list of last hashes. Groups that hold more than
``block_rows`` rows or queries are cut into a grid of cells by hashes of the ids, so a vector repeated over a
third of the table neither lands in one task nor loses rows. Nothing is broadcast. Codes are computed once and written.
A cell returns at most ``KEPT`` rows for a query, and after the first buckets none that is worse than the ``KEPT`` best already met, so what is returned grows with the queries and not with the rows they meet.

Recall of the five nearest on uniform random vectors of 64 dimensions, the hardest case, with 10 tables (60 queries, candidates of both rounds): 0.99 for 500 and 2,000 rows (78 and 46 % of rows scored), 0.97 for 10,000 (27 %), 0.96 for 51,000 (19 %). The
share of rows scored falls as the table grows, because neighbours come nearer. Larger tables were not measured; from some millions of rows a ``depth`` of 3 has smaller groups.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Shorter vectors count
as padded with zeros. Repeated ids count once, with their best score. Ties go to the smaller id. Fewer than k candidates: all are returned. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.llm.common import finite_vector, materialize
from seabright.llm.topk_threshold import matrix, rank_found

#: Rows a query keeps for the exact rerank.
KEPT = 24
#: Buckets of each table that a query opens first, the chance of meeting a neighbour in some table, random vectors that tell it (of all tables), and buckets of a table at most.
FIRST, SURE, TRIALS, MOST_PROBES = 8, 0.9, 160, 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two. Scaled to keep lengths."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width) / math.sqrt(width)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def signed_axes(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """How near each signed axis of a rotation is to each row: its components, and their negatives."""
    y = rotate(x, table, seed)
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, table: int, depth: int, seed: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For unit rows the ``probes`` best buckets of a table, best first: the number of all hashes but the last, and the last."""
    near = [signed_axes(x, table * 64 + i, seed) for i in range(depth)]
    n, axes = near[0].shape
    most = min(axes, max(2, probes) if depth == 1 else max(2, math.ceil(4 * probes ** (1 / depth)) + 8))
    loss, group, last = np.zeros((n, 1)), np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64)
    for i, y in enumerate(near):
        best = np.argsort(-y, axis=1, kind="stable")[:, :most]
        lost = (y.max(axis=1)[:, None] - np.take_along_axis(y, best, 1)) ** 2
        loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
        wide = lambda a: np.repeat(a, most, axis=1)
        if i:
            group = wide(group * axes + last)
        last = np.tile(best, (1, loss.shape[1] // most))
        keep = np.argsort(loss, axis=1, kind="stable")[:, : max(probes, most)]
        loss, last = np.take_along_axis(loss, keep, 1), np.take_along_axis(last, keep, 1)
        group = np.take_along_axis(group, keep, 1) if i else np.zeros_like(last)
    return group[:, :probes], last[:, :probes]


def losses_of_neighbours(near: list[np.ndarray], cosine: np.ndarray, trials: int, table: int, seed: int) -> np.ndarray:
    """How far behind each row's best bucket of a table those of ``trials`` random unit vectors at its ``cosine`` are. ``near`` has the signed axes of unit rows, for each hash."""
    loss, s = np.zeros((len(cosine), trials)), np.clip(cosine, -1, 1)[:, None, None]
    for i, axes in enumerate(near):
        y = axes[:, : axes.shape[1] // 2]
        g = np.random.default_rng([seed, table, i]).normal(size=(trials, y.shape[1]))
        beside = g[None] - (y @ g.T)[:, :, None] * y[:, None]
        z = s * y[:, None] + np.sqrt(1 - s * s) * beside / np.maximum(np.sqrt((beside * beside).sum(axis=2)), 1e-30)[:, :, None]
        axis = np.abs(z).argmax(axis=2)
        axis += y.shape[1] * (np.take_along_axis(z, axis[:, :, None], 2)[:, :, 0] < 0)
        loss += (axes.max(axis=1)[:, None] - np.take_along_axis(axes, axis, 1)) ** 2
    return loss


def buckets_within(near: list[np.ndarray], most_loss: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, group and last hash of each bucket of a table that is at most so far behind a row's best, in that order; and whether a row has more than ``most`` and is left out."""
    n, axes = near[0].shape
    row, loss, over = np.arange(n), np.zeros(n), np.zeros(n, bool)
    group = last = np.zeros(n, np.int64)
    for i, y in enumerate(near):
        total = loss[:, None] + ((y.max(axis=1)[:, None] - y) ** 2)[row]
        at, axis = np.nonzero(total <= most_loss[row][:, None])
        group = group[at] * axes + last[at] if i else np.zeros(len(at), np.int64)
        row, last, loss = row[at], axis, total[at, axis]
        over |= np.bincount(row, minlength=n) > most  # each leads to one bucket at least
        kept = ~over[row]
        row, group, last, loss = row[kept], group[kept], last[kept], loss[kept]
    return row, group, last, over


def in_bytes(x: np.ndarray) -> np.ndarray:
    """Rows scaled so that their largest component is 127, in whole numbers."""
    return np.rint(x * (127 / np.abs(x).max(axis=1))[:, None]).astype(np.int8)


def _stored(width: int, tables: int, depth: int, seed: int):
    def run(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column("vec")]), width)
            if not len(x):
                continue
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            small = pa.array([v.tobytes() for v in in_bytes(x)], pa.binary())
            for table in range(tables):
                axes, group = [signed_axes(unit, table * 64 + i, seed).argmax(axis=1) for i in range(depth)], 0
                for axis in axes[:-1]:
                    group = group * 2 * width + axis
                yield pa.RecordBatch.from_arrays([pa.array(group * tables + table + np.zeros(len(x), np.int64)), batch.column("id"), small, pa.array(axes[-1], pa.int32())], ["bucket", "id", "small", "last"])

    return run


ASKED = "bucket long, id long, small binary, lasts array<int>, floor float"
#: The bucket of those who are compared with all rows.
ALL = -1


def _questions(bucket: np.ndarray, row: np.ndarray, last: np.ndarray, part: pa.RecordBatch, small: pa.Array) -> pa.RecordBatch:
    """A line for each row and bucket with its list of last hashes; they come in that order."""
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))) if len(row) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(last, pa.int32()))
    who = pa.array(row[first], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), part.column("id").take(who), small.take(who), lists, part.column("floor").take(who)], ["bucket", "id", "small", "lasts", "floor"])


def _asked(width: int, tables: int, depth: int, seed: int, probes: int):
    """The ``probes`` best buckets of each table."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(pa.chunked_array([part.column("vec")]), width)
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                small = pa.array([v.tobytes() for v in in_bytes(x)], pa.binary())
                for table in range(tables):
                    group, last = buckets(unit, table, depth, seed, probes)
                    row = np.repeat(np.arange(len(x)), group.shape[1])
                    group, last = group.ravel(), last.ravel()
                    order = np.lexsort((last, group, row))
                    yield _questions(group[order] * tables + table, row[order], last[order], part, small)

    return run


def _asked_further(width: int, tables: int, depth: int, seed: int, opened: int):
    """The buckets, but for the ``opened`` best of each table, that a neighbour at the cosine ``kth`` is likely in; or all rows, where they are too many."""
    trials, hit = math.ceil(TRIALS / tables), 1 - (1 - SURE) ** (1 / tables)

    def run(batches):
        for batch in batches:
            step = max(1, (1 << 20) // (2 * width) ** 2)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(pa.chunked_array([part.column("vec")]), width)
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                small = pa.array([v.tobytes() for v in in_bytes(x)], pa.binary())
                near = [[signed_axes(unit, table * 64 + i, seed) for i in range(depth)] for table in range(tables)]
                kth = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                losses = np.concatenate([losses_of_neighbours(y, kth, trials, table, seed) for table, y in enumerate(near)], axis=1)
                found = [buckets_within(y, np.quantile(losses, hit, axis=1), MOST_PROBES) for y in near]
                every = np.any([f[3] for f in found], axis=0)
                for table, (row, group, last, _) in enumerate(found):
                    before = buckets(unit, table, depth, seed, opened)
                    new = ~every[row] & ~((before[0][row] == group[:, None]) & (before[1][row] == last[:, None])).any(axis=1)
                    yield _questions(group[new] * tables + table, row[new], last[new], part, small)
                rest = np.flatnonzero(every)
                yield _questions(np.full(len(rest), ALL), rest, np.zeros(len(rest), np.int64), part, small)

    return run


FOUND = "query_id long, vec_id long, near float"


def _met(keep: int, at_once: int = 2_000_000):
    """The rows that a cell's queries meet, at most ``keep`` of the largest approximate cosine for each, and none under its floor.

    Products of bytes are whole numbers, so a pair's cosine is the same wherever it meets.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        if queries.num_rows and rows.num_rows:
            unpack = lambda c: np.stack([np.frombuffer(v.as_py(), np.int8) for v in c]).astype(np.float32)
            size = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
            x, ids, code = unpack(rows["small"]), rows["id"].to_numpy(), rows["last"].to_numpy()
            order = np.lexsort((ids, code))
            x, ids, code = x[order], ids[order], code[order]
            q, own = unpack(queries["small"]), queries["id"].to_numpy()
            x_size, q_size = size(x), size(q)
            floor = queries["floor"].fill_null(-2).to_numpy()
            lists = queries["lasts"].combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
            wanted, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))
            by = np.argsort(wanted, kind="stable")
            wanted, asker = wanted[by], asker[by]
            for value in np.unique(wanted):
                a, b = np.searchsorted(code, [value, value + 1])
                c, d = np.searchsorted(wanted, [value, value + 1])
                for e in range(c, d, max(1, at_once // max(1, b - a))) if b > a else ():
                    who = asker[e : min(d, e + max(1, at_once // (b - a)))]
                    near = q[who] @ x[a:b].T / q_size[who][:, None] / x_size[None, a:b]
                    near[(own[who][:, None] == ids[None, a:b]) | (near < floor[who][:, None])] = -2
                    if b - a > keep:  # ties at the last place stay, to be ordered by id below
                        cut = np.partition(near, b - a - keep, axis=1)[:, b - a - keep]
                        i, j = np.nonzero((near >= cut[:, None]) & (near > -2))
                    else:
                        i, j = np.nonzero(near > -2)
                    score = near[i, j]
                    turn = np.lexsort((ids[a + j], -score, i))
                    i, j, score = i[turn], j[turn], score[turn]
                    begins = np.searchsorted(i, np.arange(len(who)))
                    best = np.arange(len(i)) - begins[i] < keep
                    out.append((own[who[i[best]]], ids[a + j[best]], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        turn = np.lexsort((b, -c, a))  # the best of all last hashes together
        a, b, c = a[turn], b[turn], c[turn]
        best = np.arange(len(a)) - np.searchsorted(a, a) < keep
        a, b, c = a[best], b[best], c[best]
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "near": pa.array(c, pa.float32())})

    return run


def _meetings(asked: DataFrame, stored: DataFrame, keep: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, near of the rows that queries meet in their buckets; crowded buckets are cut into a grid."""
    cut = lambda n: F.ceil(F.col(n) / F.lit(block_rows))
    cells = (
        stored.groupBy("bucket").agg(F.count("*").alias("n")).join(asked.groupBy("bucket").agg(F.count("*").alias("q")), "bucket")
        .select("bucket", cut("n").alias("row_cells"), cut("q").alias("query_cells")).where("row_cells > 1 or query_cells > 1")
    )
    cells = materialize(cells, "crowded-buckets")
    one = F.lit(1).cast("long")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(n, one))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, one) - 1))
    left = asked.join(cells, "bucket", "left").select("id", "small", "lasts", "floor", "bucket", salt("query_cells").alias("qc"), every("row_cells").alias("rc"))
    right = stored.join(cells, "bucket", "left").select("id", "small", "last", "bucket", salt("row_cells").alias("rc"), every("query_cells").alias("qc"))
    keys = ("bucket", "rc", "qc")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_met(keep), FOUND)


def _best(found: DataFrame, keep: int) -> DataFrame:
    """query_id, vec_id, near, place of each query's ``keep`` best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def _first_met(found: DataFrame, k: int, keep: int) -> DataFrame:
    """id, kth and floor: the cosine of a query's k-th and ``keep``-th best, null where it met fewer."""
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("near")))
    return _best(found, keep).groupBy(F.col("query_id").alias("id")).agg(at(k).alias("kth"), at(keep).alias("floor"))


def _reranked(found: DataFrame, rows: DataFrame, k: int, keep: int) -> DataFrame:
    """The k best of each query's ``keep`` best, by the exact cosine."""
    best = _best(found, keep)
    of = lambda name, id_name: rows.select(F.col("id").alias(id_name), F.col("vec").alias(name))
    both = best.select("query_id", "vec_id").join(of("b", "vec_id"), "vec_id").join(of("a", "query_id"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    score = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    return rank_found(both.select("query_id", "vec_id", score.alias("score")), k)


def cross_polytope_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 10, probes: int | None = None, seed: int = 20, block_rows: int = 4096, depth: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, the k rows of largest cosine among those met.

    ``probes``: buckets of each table that a query opens, where not its neighbours shall tell.
    """
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & finite_vector(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    size = rows.agg(F.max(F.size("vec")).alias("w"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    width = 1 << max(0, ((size["w"] or 1) - 1).bit_length())
    keep = max(KEPT, 2 * k)
    queries = rows.where("is_query").select("id", "vec", F.lit(None).cast("float").alias("floor"))
    stored = materialize(rows.select("id", "vec").mapInArrow(_stored(width, tables, depth, seed), "bucket long, id long, small binary, last int"), "stored-codes")
    asked = materialize(queries.mapInArrow(_asked(width, tables, depth, seed, probes or FIRST), ASKED), "asked-codes")
    found, met_all = materialize(_meetings(asked, stored, keep, block_rows), "met"), None
    if not probes:
        told = queries.drop("floor").join(_first_met(found, k, keep), "id", "left").select("id", "vec", "floor", F.coalesce("kth", F.lit(0.0)).alias("kth"))
        asked = materialize(told.mapInArrow(_asked_further(width, tables, depth, seed, FIRST), ASKED), "asked-further")
        found = found.unionByName(materialize(_meetings(asked.where(F.col("bucket") != ALL), stored, keep, block_rows), "met-further"))
        met_all = asked.where(F.col("bucket") == ALL).select("id")
    met = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("met")).where(F.col("met") >= min(k, size["ids"] - 1)).select(F.col("query_id").alias("id"))
    met = met if met_all is None else met.join(met_all, "id", "left_anti")
    short = materialize(queries.join(met, "id", "left_anti"), "short-queries")
    if not short.isEmpty():  # all rows are one bucket to these
        everything = stored.where(F.pmod("bucket", F.lit(tables)) == 0).select(F.lit(ALL).cast("long").alias("bucket"), "id", "small", F.lit(0).alias("last"))
        again = short.mapInArrow(_asked(width, 1, 1, seed, 1), ASKED).withColumns({"bucket": F.lit(ALL).cast("long"), "lasts": F.array(F.lit(0))})
        found = found.unionByName(_meetings(again, everything, keep, block_rows))
    return _reranked(found, rows, k, keep)
