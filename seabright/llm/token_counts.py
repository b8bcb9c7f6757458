"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols stand in a doubly linked list; a heap holds each adjacent pair that can merge, by rank and place. Popping the
lowest, merging, and pushing the two new neighbours goes on until the heap is empty. The count is the initial
symbols less the merges; identifiers are never looked up for output. O(n log n) for words of any length.

The tokenizer file's other steps are followed too: special strings are cut out first and count one each; the rest is composed
(NFC), white space folded, lower-cased character by character, and split into words by the file's pattern.

Scaling: no shuffle; a document is one row in, one row out. Counts of white-space chunks are kept in a bounded cache.

Edge cases: null and empty texts count 0 tokens and 0 bytes. Repeated rows and null ids give a row each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import TwoGenerations
from seabright.llm.packing import ODD_SPACE, text_slices

BITS = 24
LOW = (1 << BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts of tokens under the merges of a tokenizers BPE file with a word-end mark."""

    _of: dict[str, MergeCounter] = {}

    def __init__(self, path: str, cache_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        ids = {s: i for i, s in enumerate(dict.fromkeys([*symbols, *(s + end for s in symbols)]))}
        self.inner, self.last = [ids[s] for s in symbols], [ids[s + end] for s in symbols]
        self.merges: dict[int, tuple[int, int]] = {}  # left id << BITS | right id -> rank, merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merged = ids.setdefault(a + b, len(ids))
            self.merges.setdefault(ids[a] << BITS | ids[b], (rank, merged))
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0])
        self.known, self.by_word = TwoGenerations(cache_entries), TwoGenerations(cache_entries)

    @classmethod
    def at(cls, path: str) -> MergeCounter:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def merged_length(self, word: bytes) -> int:
        """Symbols left of a word after all merges."""
        n = len(word)
        if n < 2:
            return n
        inner, merges = self.inner, self.merges
        symbol = [inner[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := merges.get(symbol[i] << BITS | symbol[i + 1])) is not None:
                heap.append((m[0], i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the pair has merged since
            new = symbol[i] = merges[a << BITS | b][1]
            symbol[j] = -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (m := merges.get(new << BITS | symbol[k])) is not None:
                    heapq.heappush(heap, (m[0], i, new, symbol[k]))
            h = before[i]
            if h >= 0 and (m := merges.get(symbol[h] << BITS | new)) is not None:
                heapq.heappush(heap, (m[0], h, symbol[h], new))
        return count

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings, step by step."""
        if text.isascii():
            text = text.lower()
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        total, by_word = 0, self.by_word
        for word in [text] if text.isascii() and text.isalpha() else self.words.findall(text):
            if (n := by_word.get(word)) is None:
                if (n := by_word.old.get(word)) is None:
                    n = self.merged_length(word.encode())
                if len(word) <= 64:
                    by_word.put(word, n)
            total += n
        return total

    def whole(self, text: str) -> int:
        """Tokens of any text, without the chunk cache."""
        if self.special is None:
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))

    def count(self, text: str) -> int:
        """White space ends words and is dropped, so a text's count is the sum over its chunks."""
        if ODD_SPACE.search(text) or self.special is not None and self.special.search(text):  # in their exact spelling only
            return self.whole(text)
        known = self.known
        chunks = (text.lower() if text.isascii() else text).split()
        counts = list(map(known.get, chunks))
        if None in counts:
            old = known.old
            for at, n in enumerate(counts):
                if n is None:
                    c = chunks[at]
                    if (n := known.get(c)) is None:
                        if (n := old.get(c)) is None:
                            n = self._plain(c)
                        if len(c) <= 64:
                            known.put(c, n)
                            old = known.old
                    counts[at] = n
        return sum(counts)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches):
        counter = MergeCounter.at(tokenizer)
        for batch in batches:
            counts = [counter.count(t) if t else 0 for part in text_slices(batch) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
