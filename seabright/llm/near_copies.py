"""Near copies by SimHash fingerprints and the exact Jaccard similarity of word shingles.

A document is the set of its runs of ``words`` words. Two documents are linked if their sets' Jaccard similarity is ``least`` or more.
Two such sets share an element among the first n - ceil(least * n) + 1 of each, in any order that is the same for all (prefix
filter), so only documents that meet there are compared: first by their SimHash fingerprints of 128 bits, bit-sliced, 64 pairs a word; and those within ``RADIUS`` bits
by their sets. Two sets at the least similarity of 0.8 differ in 19 bits on average (the bits of sets at an angle a differ with chance a / pi), so more than 44 has a chance
under 1e-6; sets of fewer than ``SMALL`` shingles, for which that does not hold, go without the fingerprints.

Scaling: equal sets are one node before any comparison. Shingles that are frequent in a sample come last in the order, so a passage in
many documents is no meeting point. First every node is compared with the least node of each of its meeting points; what that links is
one component (root). Roots that meet with fingerprints near enough are a family, found by a forest of each meeting point, not by its pairs; within a family the sets of
different roots are compared exactly in tiles of nodes, each by one product of matrices. Crowded meeting points are cut into tiles, and nodes with many comparisons are salted. Texts
move only for nodes that the fingerprints leave, compressed, once for each tile that theirs is compared with.

Edge cases: null texts are empty; texts without words have empty sets and are one component. Shorter texts are one shingle. Repeated rows are one component. Null ids
are compared like others and come last where one row of a component is kept. Very long texts are hashed in runs. Extra columns, whatever their names, are kept. An empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seabright.llm.common import materialize, release_memory
from seabright.llm.components import connected_components
from seabright.llm.packing import text_slices
from seabright.llm.quality_lm import MOST_IDS, texts_of
from seabright.llm.simhash import BitPlanes, in_cells, majority, shingle_hashes

SLACK = 1e-9
RADIUS, SMALL = 44, 32
AT_ONCE = 4_000_000


class Sketch(NamedTuple):
    """Words of 64 bits that tell how alike two sets are: none of more than ``radius`` differing bits are compared further (None: all are), but those of sets below ``small``."""

    columns: list[str]
    radius: int | None
    small: int


def shingle_set(text: str, words: int, seed: int) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    parts = list(shingle_hashes(text, words, seed))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def prints(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits: the majorities of the hashes, and of the hashes mixed once more."""
    mixed = shingles ^ shingles >> np.uint64(31)
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    return majority([shingles]), majority([mixed ^ mixed >> np.uint64(29)])


def prefix(shingles: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """What two linked sets must share an element of; shingles in ``common`` (sorted) come last."""
    n = len(shingles)
    if not n:
        return shingles
    late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(n, bool)
    return np.concatenate([shingles[~late], shingles[late]])[: n - math.ceil(least * n - SLACK) + 1]


def row_key(docs: DataFrame) -> F.Column:
    """Equal only for rows of the same id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def common_shingles(docs: DataFrame, words: int, seed: int, sample: int = 8000, most: int = 200_000) -> np.ndarray:
    """Shingles of three or more of about ``sample`` documents. They affect the order of comparison only, never the result."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64(F.lit(seed), row_key(docs)), F.lit(max(1, total // sample))) == 0).select(F.col("text").cast("string").alias("text")).distinct()

    def run(batches):
        for rows in (p for batch in batches for p in text_slices(batch, most_bytes=AT_ONCE)):
            for t in rows.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t or "", words, seed).view(np.int64))], ["key"])

    found = part.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(most)
    return np.sort(found.select("key").toArrow()["key"].to_numpy().view(np.uint64))


def _marked(docs: DataFrame, common: np.ndarray, words: int, seed: int, least: float) -> DataFrame:
    """row, doc_id, node (one for each distinct set), size, the two words of the fingerprint, and prefix of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch, most_bytes=AT_ONCE)):
            nodes, sizes, left, right, heads = [], [], [], [], []
            for t in part.column("text").to_pylist():
                s = shingle_set(t or "", words, seed)
                a, b = prints(s)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), seed))
                sizes.append(len(s))
                left.append(a)
                right.append(b)
                heads.append(prefix(s, shared.value, least).view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, left, right)]
            columns = [part.column("row"), part.column("doc_id"), signed[0], pa.array(sizes, pa.int64()), *signed[1:], pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "size", "left", "right", "prefix"])
        release_memory()

    rows = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, node long, size long, left long, right long, prefix array<long>")


def _alike(pairs: DataFrame, nodes: DataFrame, sketch: Sketch, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sizes and sketches let them be similar enough."""
    named = lambda side: nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in sketch.columns))
    rows = pairs.join(named("u"), "u").join(named("v"), "v")
    fits = F.least("size_u", "size_v") >= least * F.greatest("size_u", "size_v") - SLACK
    if sketch.radius is not None:
        differ = sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in sketch.columns), F.lit(0))
        fits = fits & ((F.least("size_u", "size_v") < sketch.small) | (differ <= sketch.radius))
    return rows.where(fits).select("u", "v")


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that join labels still apart, a forest; ``label`` is brought up to date."""
    a, b = label[i], label[j]
    apart = np.flatnonzero(a != b)
    used, parent = [], np.arange(int(label.max(initial=0)) + 1)
    pairs, places = np.unique(np.stack([a[apart], b[apart]]), axis=1, return_index=True)
    for x, y, at in zip(*pairs.tolist(), places.tolist(), strict=True):
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(at)
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    label[:] = parent[label]
    return apart[np.array(used, np.int64)]


def _kin(least: float, sketch: Sketch):
    """For ``in_cells``: pairs of roots that may be linked, a forest in each cell; sketches are compared bit-sliced."""

    def links(t: pa.Table, group: np.ndarray):
        size, root = t["size"].to_numpy(), t["root"].to_numpy()
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(edge, len(group)))
        begin = np.cumsum(sizes) - sizes
        ahead = np.repeat(edge + sizes, sizes) - np.arange(len(group)) - 1
        planes = BitPlanes(np.stack([t[c].to_numpy() for c in sketch.columns], axis=1).view(np.uint64))
        _, label = np.unique(np.stack([group, root]), axis=1, return_inverse=True)
        label = label.ravel()
        us, vs, small, shift = [root[:0]], [root[:0]], (size < sketch.small) | (sketch.radius is None), 1
        while True:
            whole = np.maximum.reduceat(label, begin) == np.minimum.reduceat(label, begin)
            ahead[np.repeat(whole, sizes)] = 0  # such cells are one family already
            at = np.flatnonzero(ahead >= shift)
            if not len(at):
                return np.concatenate(us), np.concatenate(vs)
            to = at + shift
            fits = (label[at] != label[to]) & (np.minimum(size[at], size[to]) >= least * np.maximum(size[at], size[to]) - SLACK)
            at, to = at[fits], to[fits]
            tiny = small[at] | small[to]
            ask = np.zeros(len(root), bool)
            ask[at[~tiny]] = True
            at = np.concatenate([at[tiny], planes.near(shift, ask, sketch.radius) if ask.any() else at[:0]])
            at = at[_merge(label, at, at + shift)]
            us.append(root[at])
            vs.append(root[at + shift])
            shift += 1

    return links


def _linked(words: int, seed: int, least: float, columns: int = 4096):
    """Links that join the roots of two tiles of nodes (or of one): all sets of one are compared with all of the other exactly, by products of their membership matrices."""

    def run(t: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        node, root, second = t["node"].to_numpy(), t["root"].to_numpy(), t["second"].to_numpy()
        sets = [shingle_set(codec.decompress(x.as_py(), n, asbytes=True).decode(), words, seed) for x, n in zip(t["packed"], t["length"].to_pylist(), strict=True)]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # the others are in no intersection
        rank = np.full(len(value), -1)
        rank[shared] = np.arange(len(shared))
        place = rank[place]
        row, place = row[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        one = np.flatnonzero(second == 0)
        two = np.flatnonzero(second == 1) if second.any() else one
        mine, theirs = (np.full(len(sets), -1) for _ in range(2))
        mine[one], theirs[two] = np.arange(len(one)), np.arange(len(two))
        both = np.zeros((len(one), len(two)), np.float32)
        for begin in range(0, len(shared), columns):
            a, b = np.searchsorted(place, [begin, begin + columns])
            r, c = row[a:b], place[a:b] - begin
            left, right = (np.zeros((len(x), columns), np.float32) for x in (one, two))
            inside = mine[r] >= 0
            left[mine[r[inside]], c[inside]] = 1
            inside = theirs[r] >= 0
            right[theirs[r[inside]], c[inside]] = 1
            both += left @ right.T
        total = size[one][:, None] + size[two][None, :] - both
        i, j = np.nonzero((both >= (least - SLACK) * total) & (root[one][:, None] != root[two][None, :]))
        _, label = np.unique(root, return_inverse=True)
        kept = _merge(label, one[i], two[j])
        u, v = node[one[i[kept]]], node[two[j[kept]]]
        if len(row) + both.size > 500_000:  # small families come by thousands, and this takes longer than most of them
            release_memory()
        return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})

    return run


def _across_roots(docs: DataFrame, marked: DataFrame, rooted: DataFrame, kin: DataFrame, words: int, seed: int, least: float, tile: int) -> DataFrame:
    """(u, v): links that join roots of a family, a family being roots that ``kin`` joins. Tiles hold up to about ``tile`` nodes, of one large root or of several small ones."""
    found = connected_components(kin).select(F.col("node").alias("root"), F.col("root").alias("family"))
    family = found.unionByName(found.select(F.col("family").alias("root"), "family").distinct())  # the root that names a family is of it
    members = materialize(rooted.select("node", "root").distinct().join(family, "root"), "families")
    counts = members.groupBy("family", "root").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") <= tile, F.col("n")).otherwise(0)
    counts = counts.join(counts.groupBy("family").agg(F.sum(small).alias("rest")), "family")
    counts = counts.select("root", F.col("n") > tile, F.ceil(F.greatest(F.when(F.col("n") > tile, F.col("n")).otherwise(F.col("rest")), F.lit(1)) / tile)).toDF("root", "large", "tiles")
    cut = F.when(F.col("large"), F.xxhash64(F.col("root"), F.pmod(F.xxhash64("node"), F.col("tiles")))).otherwise(F.pmod(F.xxhash64("root"), F.col("tiles")))
    members = materialize(members.join(counts, "root").select("node", "root", "family", cut.alias("tile")), "tiles")
    tiles = members.groupBy("family", "tile").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    first, other = tiles.toDF("family", "one", "low", "high"), tiles.toDF("family", "two", "low2", "high2")
    pairs = first.join(other, "family").where((F.col("one") <= F.col("two")) & ~((F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))))
    sides = F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("tile"), F.lit(0).alias("second")))).otherwise(F.array(F.struct(F.col("one").alias("tile"), F.lit(0).alias("second")), F.struct(F.col("two").alias("tile"), F.lit(1).alias("second")))))
    asked = pairs.select("family", "one", "two", sides.alias("s")).select("family", "one", "two", "s.tile", "s.second")
    texts = _texts(docs, marked, members.select("node"))
    held = members.join(texts, "node").join(asked, ["family", "tile"]).select("family", "one", "two", "second", "node", "root", "length", "packed")
    return held.groupBy("family", "one", "two").applyInArrow(_linked(words, seed, least), "u long, v long").distinct()


def _texts(docs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, length, packed) of ``nodes``: one compressed text each."""
    asked = nodes.distinct()
    chosen = materialize(marked.select("node", "row").join(asked, "node", "left_semi").groupBy("node").agg(F.min("row").alias("doc_id")), "chosen")

    def run(batches):
        codec = pa.Codec("zstd")
        for part in (p for batch in batches for p in text_slices(batch, most_bytes=AT_ONCE)):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], ["doc_id", "length", "packed"])
        release_memory()

    texts = texts_of(docs.select(row_key(docs).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")), chosen.select("doc_id"))
    packed = texts.mapInArrow(run, "doc_id long, length long, packed binary").dropDuplicates(["doc_id"])
    return materialize(packed.join(chosen, "doc_id").select("node", "length", "packed"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, seed: int, least: float, block: int = 2000) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar enough."""
    fan = F.broadcast(materialize(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > block).select("u", F.ceil(F.col("n") / block).alias("parts")), "fans"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = pairs.join(fan, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).alias("part"))
    first = texts.select(F.col("node").alias("u"), F.struct("length", "packed").alias("a")).join(fan, "u", "left").select("u", "a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    second = texts.select(F.col("node").alias("v"), F.struct("length", "packed").alias("b"))

    def run(batches):
        codec, last, mine = pa.Codec("zstd"), None, None
        unpack = lambda t: shingle_set(codec.decompress(t["packed"], t["length"], asbytes=True).decode(), words, seed)
        for batch in batches:
            near = []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if u != last:
                    last, mine = u, unpack(a.as_py())
                near.append(jaccard(mine, unpack(b.as_py())) >= least - SLACK)
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))
        release_memory()

    return left.join(second, "v").join(first, ["u", "part"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def meetings(points: DataFrame) -> DataFrame:
    """(key, node, n, first) of the points (node, key) whose key more than one node has: their number and the least node."""
    counts = materialize(points.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "meeting-points")
    return materialize(points.join(counts, "key"), "meetings")  # both sides are shuffled as they are, so Spark splits a hot key


def linked_components(docs: DataFrame, marked: DataFrame, nodes: DataFrame, met: DataFrame, sketch: Sketch, words: int, seed: int, least: float, tile: int) -> DataFrame:
    """(node, root) of the nodes that have links: nodes (node, size and the sketch's columns) which meet in ``met`` are linked if their sets are similar enough. ``marked`` has a row of ``docs`` for each node."""
    star = met.where(F.col("node") != F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    star = materialize(_alike(star, nodes, sketch, least), "pairs")
    links = materialize(_verified(star, _texts(docs, marked, star.select(F.explode(F.array("u", "v")).alias("node"))), words, seed, least), "links")
    rooted = met.join(connected_components(links), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted-meetings")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    own, other = F.pmod(F.xxhash64("node"), F.col("tiles")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    held = ["node", "size", *sketch.columns, "root"]
    cells = rooted.join(mixed, "key", "left_semi").join(nodes, "node").withColumn("tiles", F.ceil(F.col("n") / tile))
    cells = cells.select("key", *held, "tiles", own.alias("own"), other.alias("other"))
    cells = cells.select("key", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("cell"), *held)
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    kin = materialize(dealt.mapInArrow(in_cells(_kin(least, sketch)), "u long, v long").distinct(), "kin")
    links = links.unionByName(materialize(_across_roots(docs, marked, rooted, kin, words, seed, least, max(1, tile // 4)), "links"))
    return connected_components(links)


def near_copy_components(docs: DataFrame, words: int = 5, seed: int = 42, least: float = 0.8, tile: int = 4096, radius: int | None = RADIUS) -> DataFrame:
    """row, doc_id, component of every document: components of the links of Jaccard similarity ``least`` or more. ``radius=None`` compares all that meet by their sets."""
    marked = materialize(_marked(docs, common_shingles(docs, words, seed), words, seed, least), "shingle-sets")
    nodes = materialize(marked.select("node", "size", "left", "right").dropDuplicates(["node"]), "nodes")
    heads = marked.select("node", "prefix").dropDuplicates(["node"])
    met = meetings(heads.select("node", F.explode("prefix").alias("key")))
    roots = linked_components(docs, marked, nodes, met, Sketch(["left", "right"], radius, SMALL), words, seed, least, tile)
    return marked.join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("component"))


def keep_one_of_each(docs: DataFrame, words: int = 5, seed: int = 42, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, null ids last."""
    found = materialize(near_copy_components(docs, words, seed, least), "components")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    kept = materialize(kept.join(found.groupBy("row").agg(F.count("*").alias("times")), "row"), "kept")
    few = kept.count() <= MOST_IDS
    chosen = docs.select(F.struct("*").alias("doc"), row_key(docs).alias("row")).join(F.broadcast(kept) if few else kept, "row")
    once = chosen.where("times = 1").select("doc.*")
    order = Window.partitionBy("row").orderBy("doc.text")
    repeated = chosen.where("times > 1").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc.*")
    return once.unionByName(repeated)
