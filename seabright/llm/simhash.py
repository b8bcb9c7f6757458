"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the bitwise majority of its shingles' 64-bit hashes. Fingerprints that differ in at most ``radius``
bits are linked. The 64 bits are cut into radius + k runs; two linked fingerprints agree on at least k runs, so pairs are
compared only where the values of some k runs are equal: exact, with keys of about 21 bits for k = 2 and more for a larger k, which is chosen by the number of fingerprints. Within a key
group, bit planes stand vertically in machine words: a plane and the plane shifted by s compare all pairs at
distance s at once, carry-save counters add the differing bits of 64 pairs a word, and words in
which every pair is beyond the radius are abandoned between runs of planes.

Scaling: equal fingerprints are one row before any comparison. Groups of more than ``tile`` are cut into tiles, each pair of tiles a
group of its own, so no task holds more than two tiles. A group emits a spanning forest of its links, not the pairs. Components are
found by star contraction with each round in shared storage.

Edge cases: null texts are empty; texts without words have fingerprint zero and are linked like any other. Null ids keep
their row and never name a component, which is null only when all its ids are. Repeated rows are all
returned. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seabright.llm.common import materialize
from seabright.llm.components import connected_components
from seabright.llm.packing import text_slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def shingle_hashes(text: str, words: int, seed: int, at_once: int = 65_536) -> Iterator[np.ndarray]:
    """Hashes of the runs of ``words`` words, repeats included, some at a time; of the whole sequence if it is shorter."""
    joined = SPACES.sub(b" ", text.encode().translate(LOWER)) if len(text) > 1_000_000 else b" ".join(text.encode().translate(LOWER).split())
    joined = joined.strip(b" ")
    if not joined:
        return
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) < words:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    begins = np.append(0, gaps[: len(gaps) - words + 2] + 1)[: len(gaps) - words + 2]
    ends = np.append(gaps[words - 1 :], len(joined))
    for i in range(0, len(begins), at_once):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(begins[i : i + at_once].tolist(), ends[i : i + at_once].tolist(), strict=True)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for part in parts:
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
        n += len(part)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every document."""

    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch)):
            got = np.fromiter((majority(shingle_hashes(t or "", words, seed)) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class BitPlanes:
    """Fingerprints stood on end: plane b holds bit b of all of them, 64 to a word."""

    def __init__(self, fp: np.ndarray):
        fp = fp.astype("<u8").reshape(len(fp), -1)  # one or more words of 64 bits each
        n, bits = len(fp), 64 * fp.shape[1]
        words = n // 64 + 2
        tall = np.zeros((bits, words * 64), np.uint8)
        tall[:, :n] = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little").T
        self.planes = np.packbits(tall, axis=1, bitorder="little").view("<u8")
        self.words = words

    def near(self, shift: int, ask: np.ndarray, radius: int, run: int = 8) -> np.ndarray:
        """Positions i for which ``ask`` holds and fingerprints i and i + shift differ in at most ``radius`` bits."""
        asked = np.zeros(self.words * 64, np.uint8)
        asked[: len(ask)] = ask
        alive = np.packbits(asked, bitorder="little").view("<u8")
        at = np.flatnonzero(alive)
        alive = alive[at]
        counter = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]  # bit k of the differences of 64 pairs a word
        step, bit = shift // 64, np.uint64(shift % 64)
        for begin in range(0, len(self.planes), run):
            if not len(at):
                break
            here = self.planes[begin : begin + run]
            there = here[:, np.minimum(at + step, self.words - 1)]
            if bit:
                there = there >> bit | here[:, np.minimum(at + step + 1, self.words - 1)] << (np.uint64(64) - bit)
            over = np.zeros(len(at), np.uint64)
            for carry in here[:, at] ^ there:
                for k, digit in enumerate(counter):
                    counter[k], carry = digit ^ carry, digit & carry
                over |= carry
            alive &= ~(over | _more_than(radius, counter))
            keep = np.flatnonzero(alive)
            if len(keep) < len(at):
                at, alive, counter = at[keep], alive[keep], [digit[keep] for digit in counter]
        bits = np.unpackbits(np.ascontiguousarray(alive, "<u8").view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits)
        return at[row] * 64 + col


def _more_than(radius: int, counter: list[np.ndarray]) -> np.ndarray:
    """Where the counters exceed the radius."""
    out = np.zeros_like(counter[0])
    equal = ~out
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            out |= equal & counter[k]
            equal = equal & ~counter[k]
    return out


def spanning_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that join what is linked within each group; rows are sorted by group."""
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(edge, len(group)))
    keep = np.repeat(sizes > 1, sizes)
    fp, sizes = fp[keep], sizes[sizes > 1]
    n = len(fp)
    if not n:
        return fp, fp
    begin = np.cumsum(sizes) - sizes
    ahead = np.repeat(begin + sizes, sizes) - np.arange(n) - 1  # rows of the group that follow
    planes, label = BitPlanes(fp), np.arange(n)
    shift = 1
    while (ask := ahead >= shift).any():
        i = planes.near(shift, ask, radius)
        a, b = label[i], label[i + shift]
        if (differ := a != b).any():
            parent = np.arange(n)
            for x, y in set(zip(a[differ].tolist(), b[differ].tolist(), strict=True)):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            label = parent[label]
            whole = np.maximum.reduceat(label, begin) == np.minimum.reduceat(label, begin)
            ahead[np.repeat(whole, sizes)] = 0  # such groups are one component already
        shift += 1
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def in_cells(find, at_once: int = 200_000):
    """For mapInArrow over rows sorted by (key, cell): the links (u, v) that ``find`` makes of whole groups and their numbers."""

    def run(batches):
        held: list[pa.Table] = []
        rows = 0

        def links(t: pa.Table):
            key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            u, v = find(t, np.cumsum(new))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= at_once:
                t = pa.concat_tables(held)
                key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
                last = int(np.flatnonzero((key == key[-1]) & (cell == cell[-1]))[0])  # the last group may go on
                if last:
                    yield links(t.slice(0, last))
                held, rows = [t.slice(last)], t.num_rows - last
        if rows:
            yield links(pa.concat_tables(held))

    return run


def _compare(radius: int):
    return in_cells(lambda t, group: spanning_links(group, t["fp"].to_numpy().view(np.uint64), radius))


def runs_of(prints: int, radius: int) -> tuple[int, int]:
    """Runs to cut the bits into and how many of them make a key, so that keys tell about as many values apart as there are fingerprints."""
    agree = 2
    while agree < 5 and 1 << 64 * agree // (radius + agree) < prints / 4:
        agree += 1
    return radius + agree, agree


def near_links(prints: DataFrame, radius: int = 4, tile: int = 4096, agree: int | None = None) -> DataFrame:
    """(u, v): a forest that spans the links among distinct fingerprints (fp)."""
    runs, agree = (radius + agree, agree) if agree else runs_of(prints.count(), radius)
    cuts = [64 * i // runs for i in range(runs + 1)]
    piece = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    most = max(b - a for a, b in zip(cuts, cuts[1:]))
    keys = []
    for n, chosen in enumerate(combinations(range(runs), agree)):
        key = F.lit(n).cast("long")
        for c in chosen:
            key = key * (1 << most) + piece[c]
        keys.append(key)
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tiles", F.lit(1)) - 1))
    cells = keyed.join(crowded, "key", "left").select("key", "fp", F.coalesce(own, F.lit(0)).alias("own"), F.coalesce("tiles", F.lit(1)).alias("tiles"), other.alias("other"))
    cells = cells.select("key", (F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")).alias("cell"), "fp")
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return dealt.mapInArrow(_compare(radius), "u long, v long").distinct()


def near_duplicate_components(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id reachable by links) of every document."""
    marked = materialize(fingerprints(docs, words, seed), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    roots = connected_components(near_links(least.select("fp"), radius))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_print, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document of least id stays, as one row; rows without an id all stay."""
    found = near_duplicate_components(docs, words, seed, radius)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("seabright_row", F.row_number().over(order)).where("seabright_row = 1").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))
