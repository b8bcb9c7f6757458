"""Layer lists as trees: pre-order, visibility, moves, removals, and lists saved by earlier versions.

A table holds the lists of any number of projects: project, place (its order in the list), id (unique in a list), parent (an id, or null or empty), and what else a layer has. A layer whose parent is not in its list
stands at the top, where it can be seen, rather than nowhere. Trees may be of any depth: each round of ``tree`` doubles how far up a layer has looked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seabright.operators.stored import stored

MOSAIC, RASTER, VECTOR, TRACK, RECORDING = "mosaic", "raster", "vector", "track", "recording"
# What the first schema called imported layers.
OLD_KINDS = {"geotiff": RASTER, "tiff": RASTER, "raster": RASTER, "gpx": VECTOR}


def with_known_parents(layers: DataFrame) -> DataFrame:
    """``layers`` with ``up``: the parent if the list has it, else null."""
    ids = layers.select(F.col("project").alias("in_project"), F.col("id").alias("up"))
    return layers.join(ids, (F.col("project") == F.col("in_project")) & (F.col("parent") == F.col("up")), "left").drop("in_project")


def tree(layers: DataFrame, order: str = "place") -> DataFrame:
    """project, id, depth, path, above, shown, cycle of every layer: by ``path`` a parent comes before its children, and siblings come by ``order``.

    ``above`` are the ids over a layer from the top, ``shown`` says whether it and all of them are (where ``layers`` have visible; null counts as shown). A layer in a ring of parents, or under one, has ``cycle`` true and no path.
    """
    own = F.coalesce("visible", F.lit(True)) if "visible" in layers.columns else F.lit(True)
    key = F.struct(F.col(order).cast("long").alias("at"), F.col("id").alias("tie"))
    state = with_known_parents(layers).select("project", "id", "up", F.array(key).alias("path"), F.array().cast("array<string>").alias("above"), own.alias("shown"))
    state = stored(state, "tree")
    most = state.groupBy("project").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1)) + 1 if most else 0):
        if state.where("up is not null").isEmpty():
            break
        over = state.select(F.col("project").alias("in_project"), F.col("id").alias("of"), F.col("up").alias("next"), F.col("path").alias("far"), F.col("above").alias("over"), F.col("shown").alias("over_shown"))
        joined = state.join(over, (F.col("project") == F.col("in_project")) & (F.col("up") == F.col("of")), "left")
        far = F.col("of").isNotNull()
        state = stored(joined.select(
            "project", "id", F.col("next").alias("up"), F.when(far, F.concat("far", "path")).otherwise(F.col("path")).alias("path"),
            F.when(far, F.concat("over", F.array("of"), "above")).otherwise(F.col("above")).alias("above"), (F.col("shown") & F.coalesce("over_shown", F.lit(True))).alias("shown"),
        ), "tree")
    ring = F.col("up").isNotNull()
    clear = lambda c: F.when(~ring, F.col(c)).alias(c)
    return state.select("project", "id", F.when(~ring, F.size("above")).alias("depth"), clear("path"), clear("above"), "shown", ring.alias("cycle"))


def normalised(layers: DataFrame, order: str = "place") -> DataFrame:
    """``layers`` in pre-order, numbered anew by ``place``, children right after their parent; layers in or under a ring, see ``rings``, are left out."""
    at = tree(layers, order).where("not cycle").select("project", "id", "path")
    numbered = at.select(F.col("project").alias("in_project"), F.col("id").alias("of"), (F.row_number().over(Window.partitionBy("project").orderBy("path")) - 1).alias("new_place"))
    joined = layers.join(numbered, (F.col("project") == F.col("in_project")) & (F.col("id") == F.col("of")))
    return joined.select(*(F.col("new_place").cast("long").alias("place") if c == "place" else F.col(c) for c in layers.columns))


def rings(layers: DataFrame) -> DataFrame:
    """project, id of the layers that are in a ring of parents or under one."""
    return tree(layers).where("cycle").select("project", "id")


def moves(layers: DataFrame, asked: DataFrame) -> DataFrame:
    """project, id, moved, came, went: of each asked move (project, id, at: before which of its siblings, as they stand, it is to go), whether it changes anything, and its places among them.

    A layer never changes its parent; one whose parent is missing is not moved. One move a list.
    """
    siblings = Window.partitionBy("project", F.coalesce("up", F.lit("")))
    placed = with_known_parents(layers).withColumns({"came": F.row_number().over(siblings.orderBy("place", "id")) - 1, "many": F.count("*").over(siblings)})
    wanted = asked.select(F.col("project").alias("in_project"), F.col("id").alias("of"), F.col("at"))
    found = placed.join(wanted, (F.col("project") == F.col("in_project")) & (F.col("id") == F.col("of")))
    lost = F.col("up").isNull() & (F.coalesce("parent", F.lit("")) != "")
    went = F.when(F.col("at") > F.col("came"), F.col("at") - 1).otherwise(F.col("at"))
    moved = ~lost & (went != F.col("came")) & (went >= 0)
    return found.select("project", "id", "up", moved.alias("moved"), F.when(~lost, F.col("came")).alias("came"), F.when(~lost, F.least(went, F.col("many") - 1)).alias("went"))


def moved(layers: DataFrame, asked: DataFrame) -> DataFrame:
    """``layers`` after the asked moves, in pre-order; what is under a layer goes with it."""
    siblings = Window.partitionBy("project", F.coalesce("up", F.lit("")))
    placed = with_known_parents(layers).withColumn("sibling", F.row_number().over(siblings.orderBy("place", "id")) - 1)
    done = moves(layers, asked).where("moved").select(F.col("project").alias("in_project"), F.col("id").alias("mover"), F.coalesce("up", F.lit("")).alias("among"), "came", "went")
    joined = placed.join(done, (F.col("project") == F.col("in_project")) & (F.coalesce("up", F.lit("")) == F.col("among")), "left")
    k = F.col("sibling")
    shifted = F.when(F.col("mover").isNull(), k).when(F.col("id") == F.col("mover"), F.col("went")).when((k > F.col("came")) & (k <= F.col("went")), k - 1).when((k < F.col("came")) & (k >= F.col("went")), k + 1).otherwise(k)
    return normalised(joined.select(*layers.columns, shifted.alias("sibling_order")), "sibling_order").drop("sibling_order")


def removed(layers: DataFrame, gone: DataFrame) -> DataFrame:
    """``layers`` without those that are in ``gone`` (project, id) and all that is under them."""
    named = gone.select("project", "id").distinct()
    under = tree(layers).select("project", "id", F.explode_outer(F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("id"))).alias("over"))
    hit = under.join(named.select("project", F.col("id").alias("over")), ["project", "over"]).select("project", "id").distinct()
    return layers.join(hit, ["project", "id"], "left_anti").select(*layers.columns)


def visible_layers(layers: DataFrame) -> DataFrame:
    """``layers`` that are shown with all that is over them; in a ring, those of a ring that is shown as a whole."""
    return layers.join(tree(layers).where("shown").select("project", "id"), ["project", "id"], "left_semi").select(*layers.columns)


def _named(prefix: str, which: str | None = None) -> Column:
    return F.concat(F.lit(prefix), F.col("dataset"), *([F.lit(f":{which}")] if which else []))


def migrated(layers: DataFrame) -> DataFrame:
    """Lists saved before there was a tree, as they are today: layers without id or kind are dropped, old kinds renamed, mosaics and tracks put under their recording, and the tracks of a recording's channels made one of the fish and one of the ship.

    ``layers`` have project, place, id, parent, kind, label, dataset, subsystem, visible, show_fish and show_boat. What was shown stays shown, in the place of the first old track.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in OLD_KINDS.items() for x in pair)), F.col("kind")), F.col("kind"))
    rows = layers.where(full("id") & full("kind")).withColumns({"kind": kind, "parent": F.coalesce("parent", F.lit(""))})
    loose = F.col("kind").isin(MOSAIC, TRACK) & ~full("parent") & full("dataset")
    own = F.concat(F.col("dataset"), F.lit(" · ss"), F.coalesce(F.col("subsystem").cast("string"), F.lit("null")))
    label = F.when(loose & (F.col("kind") == MOSAIC) & (F.col("label") == own), F.concat(F.lit("ss"), F.col("subsystem").cast("string"), F.lit(" mosaic"))).otherwise(F.col("label"))
    rows = rows.withColumns({"label": label, "parent": F.when(loose, _named("rec:")).otherwise(F.col("parent"))})

    old = (F.col("kind") == TRACK) & full("dataset") & (F.col("id") != _named("track:", "fish")) & (F.col("id") != _named("track:", "boat"))
    tow = Window.partitionBy("project", "dataset")
    lit = F.coalesce("visible", F.lit(True))
    tracks = rows.where(old).withColumns({
        "nth": F.row_number().over(tow.orderBy("place", "id")), "fish_on": F.bool_or(lit & F.coalesce("show_fish", F.lit(True))).over(tow), "boat_on": F.bool_or(lit & F.coalesce("show_boat", F.lit(False))).over(tow),
    }).where("nth = 1")
    two = F.array(*(F.struct(F.lit(n).alias("n"), _named("track:", which).alias("id"), F.lit(f"{which} track").alias("label"), F.lit(which == "fish").alias("fish"), F.col(f"{which}_on").alias("on")) for n, which in enumerate(("fish", "boat"))))
    fresh = tracks.withColumn("t", F.explode(two))
    replaced = {"id": F.col("t.id"), "label": F.col("t.label"), "subsystem": F.lit(None).cast(layers.schema["subsystem"].dataType), "show_fish": F.col("t.fish"), "show_boat": ~F.col("t.fish"), "visible": F.col("t.on")}
    made = fresh.withColumns(replaced).withColumn("second", F.col("t.n")).join(rows.select("project", "id"), ["project", "id"], "left_anti")
    kept = rows.where(~F.coalesce(old, F.lit(False))).withColumn("second", F.lit(0))
    whole = kept.select(*layers.columns, "second").unionByName(made.select(*layers.columns, "second"))
    order = Window.partitionBy("project").orderBy("place", "second", "id")
    return normalised(whole.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("second").select(*layers.columns))
