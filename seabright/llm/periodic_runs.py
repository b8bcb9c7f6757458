"""Periodic runs of words: maximal stretches that repeat with a period, by a suffix tree of the words.

Stoye and Gusfield: a tandem repeat ww that the next word breaks is branching; the suffixes at its two halves part at a node of depth |w|. At each node the leaves
outside its largest child are tested for a partner |w| before or behind, which is all pairs in O(n log n). Each branching repeat is rotated to the left as far as it goes,
which makes it a maximal run; repeats of one run (of multiples of its period) merge into that of the smallest period.

The tree is that of all texts of a slice at once, in numpy: suffixes ranked by prefix doubling, nodes as intervals of equal least common prefix. Words of different texts are different symbols. A run of
exponent e holds each of its words e times, so words that occur less often between two such words cannot lie in a run; they end stretches, and only stretches long enough get a tree.

Scaling: no shuffle; a text needs memory in proportion to the part of it that such words leave, whatever the length of the runs.

Edge cases: a null text is empty, with no runs; null ids and repeated rows keep their rows; texts of any length are read whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import release_memory
from seabright.llm.packing import text_slices

#: Leaves tested at once, and words compared at once when repeats are rotated: what bounds memory besides the tree.
AT_ONCE = 2_000_000


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin, begin + 1, ... of each range, one range after the other, and the range that each belongs to."""
    of = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    return np.arange(len(of)) - first[of] + begin[of], of


def stretches(ids: np.ndarray, text: np.ndarray, least_length: int, least_exponent: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch) of the words that can lie in a run. ``ids`` are the same for equal words of one text and differ between texts.

    Each round drops words that are too rare in their stretch. The number of rounds changes the work that is left, not the result.
    """
    places, stretch = np.arange(len(ids)), text
    for _ in range(rounds):
        _, key = np.unique(ids[places], return_inverse=True)
        _, key, times = np.unique(stretch * (int(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
        kept = times[key] >= least_exponent
        if not kept.all() or stretch is text:
            places, stretch = places[kept], stretch[kept]
        elif kept.all():
            return places, stretch
        new = np.append(True, (np.diff(places) != 1) | (np.diff(stretch) != 0))[: len(places)]
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= least_length if len(number) else np.zeros(0, bool)
        places, stretch = places[long], number[long]
    return places, stretch


class SuffixTree:
    """Ranks of the suffixes of ``symbols``, in which every stretch ends in a symbol of its own, and the inner nodes as intervals of ranks."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, n = symbols, len(symbols)
        rank = np.append(np.unique(symbols, return_inverse=True)[1], -1).astype(np.int64)
        order = np.argsort(rank[:-1], kind="stable")
        size = np.bincount(rank[:-1], minlength=1)
        first = np.cumsum(size) - size
        rank[:-1] = first[rank[:-1]]
        open_ = order[size[np.searchsorted(first, rank[order], "right") - 1] > 1] if n else order
        levels, step = [rank.astype(np.int32)], 1
        while len(open_):
            a, b = rank[open_], rank[np.minimum(open_ + step, n)]
            by = np.argsort(a * (n + 1) + b + 1, kind="stable")
            open_, a, b = open_[by], a[by], b[by]
            old = np.append(True, a[1:] != a[:-1])
            new = old | np.append(True, b[1:] != b[:-1])
            at = np.arange(len(a))
            rank[open_] = a + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
            alone = new & np.append(new[1:], True)
            open_ = open_[~alone]
            step *= 2
            levels.append(rank.astype(np.int32))
        self.rank = rank[:-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.common = self._common(levels)

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Symbols that the suffixes of ranks r - 1 and r have in common; -1 at both ends."""
        n = len(self.symbols)
        common = np.full(n + 1, -1, np.int64)
        if n:
            a, b = self.order[:-1].copy(), self.order[1:].copy()
            for k in range(len(levels) - 1, -1, -1):
                same = levels[k][a] == levels[k][b]
                a[same] += 1 << k
                b[same] += 1 << k
            common[1:n] = b - self.order[1:]
        return common

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes (depth, first and end rank) and, for every child but the largest of each node, its node and its ranks: (depth, begin, end, node, child begin and end)."""
        common = self.common
        split = np.flatnonzero(common > 0)
        before, after = split - 1, split + 1
        for pointer, reach in ((before, -1), (after, 1)):  # nearest rank where less is in common (before: or as much), by jumps over what is known to have more
            jump = np.full(len(common), -1)
            jump[split] = pointer
            active = np.arange(len(split))
            while True:
                value, here = common[jump[split[active]]], common[split[active]]
                active = active[value > here if reach < 0 else value >= here]
                if not len(active):
                    break
                jump[split[active]] = jump[jump[split[active]]]
            pointer[:] = jump[split]
        place = np.full(len(common), -1)
        place[split] = np.arange(len(split))
        head = np.where(common[before] < common[split], np.arange(len(split)), place[before])
        while (up := head[head]).tobytes() != head.tobytes():
            head = up
        heads, node = np.unique(head, return_inverse=True)
        depth, begin, end = common[split[heads]], before[heads], after[heads]
        last = np.zeros(len(heads), np.int64)
        np.maximum.at(last, node, split)
        child_node = np.concatenate([node, np.arange(len(heads))])
        child_begin, child_end = np.concatenate([before, last]), np.concatenate([split, end])
        by = np.lexsort((child_end - child_begin, child_node))
        small = np.append(child_node[by][1:] == child_node[by][:-1], False)[: len(by)]
        by = by[small]
        return depth, begin, end, child_node[by], np.stack([child_begin[by], child_end[by]])

    def branching_repeats(self, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of the branching tandem repeats whose period is at a node with ``least_exponent`` leaves or more."""
        depth, begin, end, node, child = self.nodes()
        fits = (end - begin >= least_exponent)[node]
        node, child = node[fits], child[:, fits]
        n, starts, periods = len(self.symbols), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        total = np.cumsum(child[1] - child[0])
        at = 0
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            leaf, of = _ranges(child[0, at:to], (child[1] - child[0])[at:to])
            of = node[at:to][of]
            place, d = self.order[leaf], depth[of]
            for partner, left in ((place + d, place), (place - d, place - d)):
                there = np.flatnonzero((partner >= 0) & (partner < n))
                r = self.rank[partner[there]]
                there = there[(begin[of[there]] <= r) & (r < end[of[there]])]
                first, period = left[there], d[there]
                parts = self.symbols[first + period] != self.symbols[first + 2 * period]
                starts.append(first[parts])
                periods.append(period[parts])
            at = to
        return np.concatenate(starts), np.concatenate(periods)


def rotated(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can move to the left: the words before its start that equal those one period later."""
    far, active, width = np.zeros(len(start), np.int64), np.arange(len(start)), 4
    while len(active):
        going = []
        for part in np.array_split(active, max(1, len(active) * width // AT_ONCE)):
            back = start[part] - far[part]
            size = np.minimum(back, width)
            k, of = _ranges(np.ones(len(part), np.int64), size)
            here = back[of] - k
            differ = symbols[here] != symbols[here + period[part][of]]
            stop = size + 1
            np.minimum.at(stop, of[differ], k[differ])
            far[part] += stop - 1
            going.append(part[(stop > size) & (size == width)])
        active, width = np.concatenate(going), min(width * 4, 4096)
    return far


def merged(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of the maximal runs of branching repeats. Repeats of one run end where it ends; that of the smallest period is rotated, those of its multiples inside
    the run it makes are merged into it, and what is left of that end, at most a few times, goes on with its own smallest."""
    found = [(np.zeros(0, np.int64),) * 3]
    by = np.lexsort((period, start + 2 * period))
    end, period = (start + 2 * period)[by], period[by]
    while len(end):
        new = np.append(True, end[1:] != end[:-1])
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        q, at = period[first], end[first]
        begin = at - 2 * q - rotated(symbols, at - 2 * q, q)
        found.append((begin, at, q))
        rest = (period % q[of] != 0) | (end - 2 * period < begin[of])
        end, period = end[rest], period[rest]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def maximal_runs(ids: np.ndarray, text: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period), by start and period, of the maximal runs in ``ids`` (see ``stretches``) of at least that length and exponent."""
    if least_exponent < 2:
        raise ValueError("a run repeats at least twice")
    places, stretch = stretches(ids, text, least_length, least_exponent)
    ends = np.flatnonzero(np.append(stretch[1:] != stretch[:-1], True))[: len(places)]
    symbols = np.unique(ids[places], return_inverse=True)[1]
    many = len(symbols) + 1
    symbols = np.insert(symbols, ends + 1, many + np.arange(len(ends)))
    original = np.insert(places, ends + 1, -1)
    start, period = SuffixTree(symbols).branching_repeats(least_exponent)
    begin, end, period = merged(symbols, start, period)
    fits = end - begin >= np.maximum(least_length, least_exponent * period)
    begin, length, period = original[begin[fits]], (end - begin)[fits], period[fits]
    by = np.lexsort((period, begin))
    return begin[by], length[by], period[by]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts and the text of each; equal words of different texts have different ids."""
    parts, base = [np.zeros(0, np.int64)], 0
    for words in texts:
        known = dict.fromkeys(words)
        known = dict(zip(known, range(base, base + len(known)), strict=True))
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        base += len(known)
    return np.concatenate(parts), np.repeat(np.arange(len(texts)), [len(w) for w in texts])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(least_length: int, least_exponent: int):
    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch, most_bytes=4_000_000)):
            texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            ids, text = _numbered(texts)
            start, length, period = maximal_runs(ids, text, least_length, least_exponent)
            base = np.cumsum([0, *map(len, texts)])
            of = text[start]
            first = start - base[of]
            edge = np.searchsorted(of, np.arange(len(texts) + 1))
            dropped = np.zeros(len(ids) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            dropped = np.cumsum(dropped) > 0
            kept = []
            for k, words in enumerate(texts):
                if edge[k] < edge[k + 1]:
                    words = [w for w, gone in zip(words, dropped[base[k] : base[k + 1]].tolist(), strict=True) if not gone]
                kept.append(b" ".join(words).decode())
            found = pa.StructArray.from_arrays([pa.array(first), pa.array(length), pa.array(period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), runs, pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])
        release_memory()

    return run


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and collapsed (the text without what its runs repeat) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(least_length, least_exponent), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """One row of numbers and digests for each row of ``periodic_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.withColumn("best", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
