"""GPX tracks, routes and waypoints: points as rows, and text from rows.

Reading is lenient: anything with a ``<gpx`` element is scanned for points; those not on the earth are dropped.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seabright.sources.common import rows_of

SCHEMA = "path string, kind string, line int, line_name string, seq int, lat double, lon double, ele double, time string, name string, desc string"
TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
POINTS = {"trkpt": "track", "rtept": "route", "wpt": "waypoint"}


def _tags(pieces: Iterable[str]) -> Iterator[tuple[re.Match, str]]:
    """Tags of a text that comes in pieces, each with the text since the tag before; no more is held than what no tag has ended yet."""
    held, ended = "", False
    pieces = iter(pieces)
    while not ended:
        piece = next(pieces, None)
        ended, held = piece is None, held + (piece or "")
        at = 0
        for m in TAG.finditer(held):
            yield m, held[at : m.start()]
            at = m.end()
        held = held[at:]


def points(pieces: Iterable[str]) -> Iterator[dict]:
    """Points of a document that comes in pieces, in order; those of a line are held until its name is known, or the line ends. Raises ValueError where there is no ``<gpx`` element."""
    line, names, point, seq, inner, held, found = -1, {}, None, 0, "", [], False

    def named(p: dict) -> dict:
        return p | {"line_name": names.get(p["line"])}

    for m, before in _tags(pieces):
        close, tag, attributes, empty = m[1], m[2].rpartition(":")[2], m[3], m[4]
        found = found or (tag == "gpx" and not close)
        said, whole = inner + before, None
        inner = said + m[0] if close and tag not in POINTS else ""  # text goes over the end of an element, not over points
        if tag in ("trk", "rte") and not close:
            yield from map(named, held)
            held, line, seq = [], line + 1, 0
        elif tag in POINTS and not close:
            at = {k: a or b for k, a, b in ATTRIBUTE.findall(attributes)}
            try:
                point = {"kind": POINTS[tag], "line": line if tag != "wpt" else None, "seq": seq, "lat": float(at["lat"]), "lon": float(at["lon"])}
            except (KeyError, ValueError):
                point = None
                continue
            seq += 1
            if empty:
                whole, point = point, None
        elif tag in POINTS and point is not None:
            whole, point = point, None
        elif close and tag in ("ele", "time", "name", "desc"):
            said = html.unescape(re.sub(r"^<!\[CDATA\[(.*)\]\]>$", r"\1", said.strip(), flags=re.S))
            if point is None and tag == "name" and line >= 0:
                names.setdefault(line, said)
            elif point is not None:
                try:
                    point[tag] = float(said) if tag == "ele" else said
                except ValueError:
                    pass
        if whole is not None and abs(whole["lat"]) <= 90 and abs(whole["lon"]) <= 180:
            held.append(whole)
        if held and (line in names or line < 0):
            yield from map(named, held)
            held = []
    yield from map(named, held)
    if not found:
        raise ValueError("no gpx element")


def parse(text: str) -> list[dict]:
    """Points of a document, in order. Raises ValueError where there is no ``<gpx`` element."""
    return list(points([text]))


def _pieces(raw: pa.Scalar, size: int = 1 << 20) -> Iterator[str]:
    """The text of a document a piece at a time; its bytes stay where they are."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    view = memoryview(raw.as_buffer())
    for at in range(0, len(view), size):
        yield decoder.decode(view[at : at + size])
    yield decoder.decode(b"", True)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Points of all documents at ``path``; a document without a gpx element fails the read. A document's bytes are held once, its text and points by pieces."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return rows_of(files, SCHEMA, lambda batch: zip(batch.column("path").to_pylist(), batch.column("content"), strict=True), lambda name, raw: ({"path": name} | p for p in points(_pieces(raw))))


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _element(tag: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit(f"<{tag}>"), escaped(text), F.lit(f"</{tag}>"))).otherwise("")


def documents(points: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """path, gpx: one document for each path of points: path, line, line_name, seq, lat, lon, and kind ("track" unless told), ele, time, name and desc where they are known.

    Waypoints come first, then routes, then tracks, in order of their lines; a document read again has the same points in that order. ``about`` (path, name, desc) gives documents a name and a description. A document is one row.
    """
    kinds = {"kind": F.lit("track"), **{c: F.lit(None).cast("string") for c in ("time", "name", "desc")}, "ele": F.lit(None).cast("double"), "line_name": F.lit(None).cast("string")}
    points = points.withColumns({c: given for c, given in kinds.items() if c not in points.columns})
    tag = F.when(F.col("kind") == "waypoint", "wpt").when(F.col("kind") == "route", "rtept").otherwise("trkpt")
    at = F.concat(F.lit("<"), tag, F.lit(' lat="'), F.format_string("%.7f", "lat"), F.lit('" lon="'), F.format_string("%.7f", "lon"), F.lit('">'))
    point = F.concat(at, _element("ele", F.col("ele").cast("string")), *(_element(c, F.col(c)) for c in ("time", "name", "desc")), F.lit("</"), tag, F.lit(">"))
    rank = F.when(F.col("kind") == "waypoint", 0).when(F.col("kind") == "route", 1).otherwise(2)
    of_line = F.when(F.col("kind") != "waypoint", F.col("line"))
    rows = points.select("path", rank.alias("rank"), of_line.alias("line"), F.when(F.col("kind") != "waypoint", F.col("line_name")).alias("line_name"), "seq", point.alias("p"))
    lines = rows.groupBy("path", "rank", "line").agg(F.max("line_name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda x: x["p"]), "\n").alias("body"))
    name = _element("name", F.col("name"))
    whole = F.when(F.col("rank") == 0, F.col("body")).when(F.col("rank") == 1, F.concat(F.lit("<rte>"), name, F.lit("\n"), "body", F.lit("\n</rte>"))).otherwise(F.concat(F.lit("<trk>"), name, F.lit("<trkseg>\n"), "body", F.lit("\n</trkseg></trk>")))
    bodies = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line", whole.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="seabright" xmlns="http://www.topografix.com/GPX/1/1">\n'
    meta = F.lit("")
    if about is not None:
        bodies = bodies.join(about.select("path", F.col("name").alias("called"), F.col("desc").alias("told")), "path", "left")
        meta = F.concat(F.lit("<metadata>"), _element("name", F.col("called")), _element("desc", F.col("told")), F.lit("</metadata>\n"))
    return bodies.select("path", F.concat(F.lit(head), meta, "body", F.lit("\n</gpx>\n")).alias("gpx"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """A folder ``path=...`` for each document, with it as one file; every document is a task's work."""
    documents.repartition("path").write.mode("overwrite").partitionBy("path").text(folder)
