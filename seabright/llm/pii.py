"""Personal data: fixed patterns, and spans added by a BiLSTM-CRF tagger.

The patterns find e-mail addresses, IPv4 addresses, payment cards and international telephone numbers. The tagger reads the whole of every text in
overlapping windows. A position covered by two windows takes its tag from the
one whose middle is nearer; spans are then formed over the whole text, checked by kind, and added where they touch no pattern's span.

Scaling: no shuffle; a document is one row in, one row out. The tagger (a few thousand weights) is trained on the driver from made examples, kept in the shared folder for later
queries, and broadcast.

Edge cases: null and empty texts have no spans. Repeated rows and null ids give a row each. Very long texts are read in windows like others, and patterns run in
time linear in the text, however long its runs of digits or letters. Extra columns, whatever their names, are ignored by ``find_personal_data`` and kept by ``redact``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.packing import text_slices
from seabright.llm.pii_tagger import KINDS, Tagger, classes_of, kept, luhn
from seabright.llm.common import release_memory

Span = tuple[int, int, int]  # kind, start, end

USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DATE = re.compile(r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}")
TRIGGER = re.compile(r"[0-9@]")  # every pattern needs one of these
DIGITS = re.compile(r"[0-9]+")

#: Bytes of text that are read at once.
AT_ONCE = 4_000_000
WIDTH, STRIDE = 192, 168
#: Of the characters that two windows share, each has the half nearer to its middle.
MARGIN = (WIDTH - STRIDE) // 2


def _emails(text: str) -> list[Span]:
    """Matches of a user part, ``@`` and a host with a dot, found outward from each ``@``."""
    found, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in USER:
            start -= 1
        if start < at and (host := HOST.match(text, at + 1)):
            found.append((0, start, host.end()))
            floor = host.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and then start."""
    if not TRIGGER.search(text):
        return []
    found = _emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m[0]))
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
            found.append((3, *m.span()))
    return found


WRITTEN = (
    re.compile(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]+)+"),
    re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}"),
    re.compile(r"[0-9]+(?:[ ./-][0-9]+)*"),
    re.compile(r"(?:\+|\()?[0-9][0-9 ().-]*[0-9]"),
)


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the tagger can be what it says."""
    if not WRITTEN[kind].fullmatch(text):
        return False
    digits = "".join(DIGITS.findall(text))
    if kind == 1:
        return all(int(p) <= 255 for p in DIGITS.findall(text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15 and not DATE.search(text)


def windows_of(length: int) -> int:
    """The number of windows, STRIDE apart, that cover a text."""
    return 0 if not length else 1 + max(0, -(-(length - WIDTH) // STRIDE))


def reconcile(length: int, tags: np.ndarray) -> np.ndarray:
    """One tag for each position of a text from the tags of all its windows."""
    if len(tags) == 1:
        return tags[0, :length]
    middle = tags[1:-1, MARGIN : MARGIN + STRIDE].ravel()
    return np.concatenate([tags[0, : MARGIN + STRIDE], middle, tags[-1, MARGIN:]])[:length]


def tagged_spans(text: str, tags: np.ndarray) -> list[Span]:
    """Plausible spans that the tags spell."""
    found = []
    kinds = (tags.astype(np.int8) + 1) // 2  # from 1
    goes_on = np.append((kinds[1:] == kinds[:-1]) & (tags[1:] % 2 == 0), False)  # into the next position
    begins = (tags > 0) & ~np.append(False, goes_on[:-1])
    for start, end in zip(np.flatnonzero(begins).tolist(), (np.flatnonzero((tags > 0) & ~goes_on) + 1).tolist(), strict=True):
        kind = int(kinds[start]) - 1
        while start < end and text[start] in " \n,;:":
            start += 1
        while end > start and text[end - 1] in " \n.,;:":
            end -= 1
        if start < end and plausible(kind, text[start:end]) and not _cut_short(text, start, end):
            found.append((kind, start, end))
    return found


def _cut_short(text: str, start: int, end: int) -> bool:
    """Whether a span ends inside a word or number."""
    return (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def merge(base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans, and the added ones that overlap neither them nor an earlier added one; by kind and then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, floor = list(base), 0
    for kind, a, b in sorted(added, key=lambda s: (s[1], -s[2])):
        before = bisect_left(starts, b)  # base spans that begin before this one ends
        if a >= floor and not (before and reach[before - 1] > a):
            out.append((kind, a, b))
            floor = b
    return sorted(out)


def find_spans(texts: list[str], tagger: Tagger, at_once: int = 768) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    out = [(b, b) for b in base]
    first: dict[str, int] = {}
    rows = [row for row, t in enumerate(texts) if t and first.setdefault(t, row) == row]  # equal texts are read once
    counts = np.array([windows_of(len(texts[row])) for row in rows], np.int64)
    if not len(rows):
        return out
    codes = [classes_of(texts[row]) for row in rows]
    room = (counts - 1) * STRIDE + WIDTH
    begins = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), np.uint8)
    for at, c in zip(begins.tolist(), codes, strict=True):
        flat[at : at + len(c)] = c
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    starts = begins[owner] + (np.arange(len(owner)) - (ends - counts)[owner]) * STRIDE
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at in range(0, len(starts), at_once):
        part = starts[at : at + at_once]
        tags = tagger.decode(flat[part[:, None] + np.arange(WIDTH)])
        for i in np.flatnonzero(tags.any(axis=1)).tolist():
            found.setdefault(int(owner[at + i]), []).append((at + i, tags[i]))
    for which, windows in found.items():
        mine = np.zeros((int(counts[which]), WIDTH), np.int8)
        for window, tags in windows:
            mine[window - int(ends[which] - counts[which])] = tags
        row = rows[which]
        text = texts[row]
        out[row] = base[row], merge(base[row], tagged_spans(text, reconcile(len(text), mine)))
    return [out[first[t]] if t else o for t, o in zip(texts, out, strict=True)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, training_windows: int = 25600) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(kept(docs.sparkSession, training_windows))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, most_bytes=AT_ONCE):
                found = find_spans([t or "" for t in part.column("text").to_pylist()], shared.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
                digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, pa.array([listed(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of touching spans replaced by the name of the first one's kind."""
    out, floor = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= floor:
            out += [text[floor:a], f"[{KINDS[kind].upper()}]"]
        floor = max(floor, b)
    return "".join(out) + text[floor:]


def redact(docs: DataFrame, training_windows: int = 25600) -> DataFrame:
    """``docs`` with all spans replaced in text, and n_chars counted anew where there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(kept(docs.sparkSession, training_windows))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, most_bytes=AT_ONCE):
                texts = part.column("text").to_pylist()
                found = find_spans([t or "" for t in texts], shared.value)
                clean = pa.array([t if t is None or not s else redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)], part.schema.field("text").type)
                yield part.set_column(at, "text", clean)
        release_memory()

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
