"""A survey report: its plan of charts with their layers and legends, totals per recording and overall, positions in several systems, and an HTML page of them."""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.functions.geodesy import utm_epsg, with_projected
from seabright.operators import imaging, navigation
from seabright.operators.contacts import hms, iso8601, safe_name
from seabright.operators.mosaic import RAMPS


def dataset_summary(pings: DataFrame, track: DataFrame, lines: DataFrame) -> DataFrame:
    """Per recording: pings, span of time, metres run, lines and metres of track box; null where a part is missing."""
    times = pings.groupBy("dataset").agg(F.count("*").alias("pings"), F.min("time").alias("begins"), F.max("time").alias("ends"))
    run = track.groupBy("dataset").agg(F.max("dist").alias("metres"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    straight = lines.where("kind = 'line'").groupBy("dataset").agg(F.count("*").alias("lines"))
    rows = times.join(run, "dataset", "left").join(straight, "dataset", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return rows.withColumns({"from": iso8601(F.col("begins")), "duration": hms(F.col("ends") - F.col("begins"))})


def totals(summary: DataFrame) -> DataFrame:
    """One row over all recordings."""
    return summary.agg(
        F.count("*").alias("datasets"), F.sum("pings").alias("pings"), F.round(F.sum("metres") / 1000, 3).alias("km"), F.min("begins").alias("begins"), F.max("ends").alias("ends"),
        F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"), F.sum("lines").alias("lines"),
    )


def contact_table(contacts: DataFrame, epsgs: list[int]) -> DataFrame:
    """Contacts (id, lat, lon, ...) with their coordinates in each system."""
    for epsg in epsgs:
        contacts = with_projected(contacts, epsg, "lat", "lon", f"x_{epsg}", f"y_{epsg}")
    return contacts


def render(title: str, sections: dict[str, DataFrame], most_rows: int = 10_000) -> str:
    """An HTML page with a table for each summary; a summary is one row a recording or contact. More rows than ``most_rows`` raise."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.take(most_rows + 1)
        if len(rows) > most_rows:
            raise ValueError(f"section {name} has more than {most_rows} rows")
        cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in row) + "</tr>"
        parts.append(f"<h2>{html.escape(name)}</h2><table>{cells('th', df.columns)}{''.join(cells('td', r) for r in rows)}</table>")
    return "\n".join(parts)


def band_titles(bands: DataFrame, *by: str) -> DataFrame:
    """``bands`` (``by``, subsystem, f0, f1, centre in hertz) with title and subtitle: high and low frequency where exactly two are known, else the frequency itself."""
    khz = lambda hz: F.when(hz > 0, F.floor(hz / 1000 + 0.5).cast("long"))
    middle = khz(F.when(F.col("centre") > 0, F.col("centre")).otherwise((F.col("f0") + F.col("f1")) / 2))
    rows = bands.withColumns({"khz": middle, "sweep": khz(F.abs(F.col("f1") - F.col("f0")))})
    group = Window.partitionBy(*by)
    said = F.concat(F.col("khz").cast("string"), F.lit(" kHz"))
    two = (F.count("khz").over(group) == 2) & F.col("khz").isNotNull()
    number = F.concat(F.lit("ss"), F.col("subsystem").cast("string"))
    title = F.when(two, F.when(F.col("khz") == F.max("khz").over(group), "High frequency").otherwise("Low frequency")).otherwise(F.coalesce(said, F.concat(F.lit("Channel "), number)))
    rows = rows.withColumn("title", title)
    parts = F.concat_ws(" · ", F.when(F.col("title") != said, said), F.concat(F.col("sweep").cast("string"), F.lit(" kHz sweep")), number)
    return rows.withColumn("subtitle", parts).drop("khz", "sweep")


def chart_plan(datasets: DataFrame, bands: DataFrame) -> DataFrame:
    """project, place, chart, kind, dataset, subsystem, title, subtitle of the charts of each project's report: the coverage of every band, then every band of every recording.

    ``datasets`` (project, dataset, at) are those that are enabled and loaded, ``bands`` (dataset, subsystem, f0, f1, centre) what each has. A band is named among the project's, by the first recording that knows its frequency.
    """
    own = datasets.join(bands, "dataset")
    first = F.min(F.struct((F.coalesce("centre", F.lit(0.0)) <= 0).alias("unknown"), "at", "f0", "f1", "centre"))
    merged = own.groupBy("project", "subsystem").agg(first.alias("b")).select("project", "subsystem", "b.f0", "b.f1", "b.centre")
    named = band_titles(merged, "project").select("project", "subsystem", "title", "subtitle")
    chart = lambda *parts: safe_name(F.concat_ws("-", *parts))
    whole = named.select("project", F.lit(-1).cast("long").alias("at"), chart(F.lit("ov"), "subsystem").alias("chart"), F.lit("overview").alias("kind"), F.lit("").alias("dataset"), "subsystem", F.concat(F.lit("Coverage — "), "title").alias("title"), "subtitle")
    each = own.select("project", "dataset", F.col("at").cast("long").alias("at"), "subsystem").join(named, ["project", "subsystem"])
    each = each.select("project", "at", chart(F.lit("ds"), "dataset", "subsystem").alias("chart"), F.lit("dataset").alias("kind"), "dataset", "subsystem", "title", "subtitle")
    place = F.row_number().over(Window.partitionBy("project").orderBy("at", "subsystem", "dataset")) - 1
    return whole.unionByName(each).withColumn("place", place).select("project", "place", "chart", "kind", "dataset", "subsystem", "title", "subtitle")


def chart_layers(plan: DataFrame, layers: DataFrame, datasets: DataFrame) -> DataFrame:
    """project, chart, place, id, on, boat, fish: the layers that each chart could draw, in the order of the tree, with what it draws unless told otherwise.

    ``layers``: project, place, id, kind, dataset, subsystem, show_fish, show_boat. A mosaic belongs to its band; a track shows the ship on an overview and the fish in a recording's own chart; imported layers are off.
    """
    charts = plan.select("project", "chart", F.col("kind").alias("of"), F.col("dataset").alias("chart_dataset"), F.col("subsystem").alias("band"))
    known = datasets.select("project", F.col("dataset").alias("known_dataset"))
    own = F.col("kind").isin("mosaic", "track")
    rows = layers.where(F.col("kind").isin("mosaic", "track", "raster", "vector")).join(charts, "project")
    rows = rows.where(~own | (F.col("kind") == "track") | (F.col("subsystem") == F.col("band"))).where(~own | (F.col("of") == "overview") | (F.col("dataset") == F.col("chart_dataset")))
    rows = rows.join(known.withColumnRenamed("project", "p"), (F.col("project") == F.col("p")) & (F.col("dataset") == F.col("known_dataset")), "left").where(~own | (F.col("of") != "overview") | F.col("known_dataset").isNotNull())
    track = F.col("kind") == "track"
    boat = F.when(own, F.when(track, F.coalesce("show_boat", F.lit(False))).otherwise(True)).otherwise(False)
    fish = F.when(own, F.when(track, F.coalesce("show_fish", F.lit(True))).otherwise(F.col("of") == "dataset")).otherwise(True)
    on = own & (~track | F.when(F.col("of") == "dataset", fish).otherwise(boat))
    return rows.select("project", "chart", "place", "id", on.alias("on"), boat.alias("boat"), fish.alias("fish"))


def with_choices(offered: DataFrame, stored: DataFrame) -> DataFrame:
    """``offered`` chart layers with what was chosen before (project, chart, id, on, boat, fish) where a layer is still there."""
    old = stored.select("project", "chart", "id", F.lit(True).alias("chosen"), F.coalesce("on", F.lit(True)).alias("was_on"), F.coalesce("boat", F.lit(False)).alias("was_boat"), F.coalesce("fish", F.lit(True)).alias("was_fish"))
    rows = offered.join(old, ["project", "chart", "id"], "left")
    pick = lambda c: F.when(F.col("chosen"), F.col(f"was_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("project", "chart", "place", "id", pick("on"), pick("boat"), pick("fish"))


def ramp_stops(ramp: Column, n: int = 7) -> Column:
    """Colours at even shares of a ramp, as a page writes them; of the first ramp where it is unknown."""
    shares = np.linspace(0, 1, n)
    stops = {name: np.stack([np.floor(np.interp(shares, [s[0] for s in r], [s[k] for s in r]) + 0.5) for k in (1, 2, 3)], axis=1).astype(int) for name, r in RAMPS.items()}
    written = {name: F.array(*(F.lit(f"#{r:02x}{g:02x}{b:02x}") for r, g, b in colours.tolist())) for name, colours in stops.items()}
    known = F.create_map(*(x for name, colours in written.items() for x in (F.lit(name), colours)))
    return F.coalesce(F.element_at(known, ramp), next(iter(written.values())))


def legends(chosen: DataFrame, layers: DataFrame) -> DataFrame:
    """project, chart, place, label, kind, colour, ramp, detail: a row for each layer that a chart draws, in the order of the tree.

    ``layers``: project, id, kind, label, colour, info, ramp. A track that shows neither the fish nor the ship has no row.
    """
    rows = chosen.where("on").join(layers.select("project", "id", "kind", "label", "colour", "info", "ramp"), ["project", "id"])
    said = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
    kind = F.col("kind")
    ramp_name = F.coalesce("ramp", F.lit(next(iter(RAMPS))))
    tow = F.when(F.col("fish") & F.col("boat"), "towfish and vessel track").when(F.col("fish"), "towfish track").when(F.col("boat"), "vessel track")
    colour = F.when(kind.isin("mosaic", "raster"), "").when(kind == "track", said("colour", F.lit("#35b8a6"))).otherwise(said("colour", F.lit("#f0b429")))
    detail = F.when(kind == "mosaic", F.concat(F.lit("sidescan backscatter, "), ramp_name, F.lit(" scheme"))).when(kind == "raster", said("info", F.lit("imported grid"))).when(kind == "track", tow).otherwise(said("info", F.lit("imported vectors")))
    ramp = F.when(kind.isin("mosaic", "raster"), ramp_stops(ramp_name)).otherwise(F.array().cast("array<string>"))
    return rows.select("project", "chart", "place", said("label", F.col("id")).alias("label"), "kind", colour.alias("colour"), ramp.alias("ramp"), detail.alias("detail")).where("detail is not null")


def positions(pings: DataFrame, track: DataFrame, layback: float, towpoint: float, step: int = 101) -> DataFrame:
    """dataset, middle, most, altitude, near_m, far_m: how far the three models of the tow put the fish apart, and how high it flew and where its beam met the bottom; null where a recording does not tell."""
    spread = navigation.model_spread(track, layback, step, towpoint)
    beam = imaging.median_altitude(pings, "dataset").join(imaging.beam_reach(pings, "dataset"), "dataset", "left")
    return spread.join(beam, "dataset", "full_outer")


def contact_positions(contacts: DataFrame, asked: list[int] | None = None) -> DataFrame:
    """id, epsg, x, y as printed, a row for each contact and system: WGS 84 and those asked for, or else the UTM zone of the first contact by id."""
    codes = list(dict.fromkeys([4326, *(asked or [])]))
    if not asked:
        first = contacts.where("lat is not null and lon is not null").orderBy("id").select(utm_epsg(F.col("lat"), F.col("lon")).alias("epsg")).first()
        codes += [first.epsg] if first else []
    out = None
    for epsg in codes:
        shape = "%.8f" if epsg == 4326 else "%.2f"
        one = with_projected(contacts.select("id", "lat", "lon"), epsg, "lat", "lon", "px", "py").select("id", F.lit(epsg).alias("epsg"), F.format_string(shape, "px").alias("x"), F.format_string(shape, "py").alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def legend_html(rows: list, caption: str) -> str:
    """A legend's block of a page, from the rows of one chart of ``legends``."""
    if not rows:
        return ""
    items = []
    for r in rows:
        style = f"linear-gradient(to right,{','.join(map(html.escape, r['ramp']))})" if r["ramp"] else html.escape(r["colour"])
        shape = "sw ramp" if r["ramp"] else "sw line" if r["kind"] in ("track", "vector") else "sw"
        items.append(f'<li><span class="{shape}" style="background:{style}"></span><span class="lg-name">{html.escape(r["label"])}</span><span class="lg-kind">{html.escape(r["kind"])}</span><span class="lg-detail">{html.escape(r["detail"])}</span></li>')
    return f'<div class="legend"><h3>Legend</h3><p class="lede">{html.escape(caption)}</p><ul>{"".join(items)}</ul></div>'
