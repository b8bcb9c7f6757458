"""Near-duplicates by min-max hashing of word shingles, with links confirmed on the full sets.

A document is the set of its runs of ``words`` words. Each permutation of the shingles (multiplication of their 64-bit hashes by an odd number) gives two signature values, the
least and the greatest, so ``permutations`` hash evaluations a shingle give twice as many values. Either agrees between two sets with a chance equal to their Jaccard similarity, and the two of one permutation
disagree rather not at once than at once, so their mean varies less than that of as many independent ones. ``rows`` values make a band, of minima only or of maxima only of different permutations;
documents that agree in a band are candidates. At a similarity of 0.8 a band of 4 agrees with a chance of 0.41 and none of 40 does with 7e-10.

Candidates are thinned by one bit of each signature value, bit-sliced: linked sets differ in 16 of 160 bits on average (0.1 each), and more than ``RADIUS`` with a chance under 1e-9. What is
left is compared by whole sets: first each set with the least that it meets, then those of different components that meet, in tiles. No pair is left out but with those chances.

Scaling: equal sets (by 128 bits) are one node before any comparison. Band keys are counted with map-side partials; only nodes that meet others go on. Crowded bands are cut into tiles. Texts move only for nodes that have
candidates left, compressed.

Edge cases: null texts are empty; documents without words have no shingles, are linked with nothing and are kept. Fewer words than ``words`` are one shingle. Repeated rows are one component and all returned.
Null ids keep their row, never name a component and are not kept; a component without ids is null. Texts of any length are read whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import materialize, release_memory
from seabright.llm.near_copies import AT_ONCE, Sketch, linked_components, meetings, row_key, shingle_set
from seabright.llm.packing import text_slices

PERMUTATIONS, ROWS = 80, 4
RADIUS = 44
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * MIX
    return values ^ values >> np.uint64(29)


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd numbers: each multiplication is a permutation of the 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64, endpoint=False) | np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of the shingles' hashes under each permutation."""
    least, greatest = np.full(len(by), 2**64 - 1, np.uint64), np.zeros(len(by), np.uint64)
    for i in range(0, len(shingles), at_once):
        values = by[:, None] * shingles[None, i : i + at_once]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(greatest, values.max(axis=1), out=greatest)
    return least, greatest


def band_keys(least: np.ndarray, greatest: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` minima and each of as many maxima."""
    values = np.concatenate([least.reshape(-1, rows), greatest.reshape(-1, rows)])
    keys = np.arange(len(values), dtype=np.uint64)
    for column in values.T:
        keys = mixed(keys * MIX + column)
    return keys


def signature_bits(least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """One bit of each value, in words of 64."""
    bits = (mixed(np.concatenate([least, greatest])) >> np.uint64(63)).astype(np.uint8)
    packed = np.packbits(bits, bitorder="little")
    return np.append(packed, np.zeros(-len(packed) % 8, np.uint8)).view("<u8")


def _marked(docs: DataFrame, words: int, seed: int, permutations: int, rows: int) -> DataFrame:
    """row, doc_id, name (two words, of the set), size, bits and keys of every document."""
    by = multipliers(permutations, seed)

    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch, most_bytes=AT_ONCE)):
            high, low, sizes, bits, keys = [], [], [], [], []
            for t in part.column("text").to_pylist():
                s = shingle_set(t or "", words, seed)
                name = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
                high.append(name >> 64)
                low.append(name & 2**64 - 1)
                sizes.append(len(s))
                least, greatest = signature(s, by)
                bits.append(signature_bits(least, greatest).view(np.int64))
                keys.append((band_keys(least, greatest, rows) if len(s) else least[:0]).view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (bits, keys)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *signed, pa.array(sizes, pa.int64()), *longs], ["row", "doc_id", "high", "low", "size", "bits", "keys"])
        release_memory()

    given = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "row long, doc_id long, high long, low long, size long, bits array<long>, keys array<long>")


def minmax_components(docs: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42, permutations: int = PERMUTATIONS, rows: int = ROWS, radius: int | None = RADIUS, tile: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of Jaccard similarity ``least`` or more) and kept of every document. ``radius=None`` compares all candidates by their sets."""
    if permutations % rows:
        raise ValueError("bands are of whole rows")
    marked = materialize(_marked(docs, words, seed, permutations, rows), "signatures")
    full = marked.where("size > 0")
    named = materialize(full.groupBy("high", "low").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "sets")
    # The two words name a set; the first, or a mix with the second where sets share the first, is its number.
    shared = named.groupBy("high").agg(F.count("*").alias("n")).where("n > 1").select("high", F.lit(True).alias("shared"))
    numbered = named.join(shared, "high", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("high", "low")).otherwise(F.col("high"))).drop("shared")
    numbered = materialize(numbered, "numbered-sets")
    columns = [f"bits{k}" for k in range(-(-2 * permutations // 64))]
    nodes = numbered.select("node", "size", *(F.col("bits")[k].alias(c) for k, c in enumerate(columns)))
    met = meetings(numbered.select("node", F.explode("keys").alias("key")))
    roots = linked_components(docs, numbered.select("node", "row"), nodes, met, Sketch(columns, radius, 0), words, seed, least, tile)
    rooted = numbered.select("node", "high", "low", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = materialize(rooted.join(named, "root").select("high", "low", "component_id"), "set-components")
    linked = full.select("doc_id", "size", "high", "low").join(of_set, ["high", "low"]).select("doc_id", "size", "component_id")
    alone = marked.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
