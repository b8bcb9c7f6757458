"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _with_least(rows: DataFrame, hub: int) -> DataFrame:
    """``rows`` (u, v) with m, the least v of each u. The rows of a u that has more than ``hub`` are dealt over several tasks."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / hub)
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", parts.alias("parts")))  # at most rows / hub, see HUBS
    one = F.lit(1).cast("long")
    dealt = rows.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", one)).alias("part"))
    return dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, itself included."""
    return _with_least(_both_ways(edges), hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), hub)
    return down.select("v", "m").union(down.select("u", "m")).toDF("u", "v").where("u <> v")


#: Nodes whose rows are dealt out, at most: what is broadcast is bounded by it.
HUBS = 100_000
SMALLEST_HUB = 5000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) that is not a root itself; the root is the least node of its component.

    Each round is written to shared storage, so lineage stays short; rounds grow with the logarithm of the diameter.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        hub = max(SMALLEST_HUB, 2 * before[0] // HUBS)
        then = materialize(_small_star(_large_star(now, hub).distinct(), hub).distinct(), "edges")
        discard(now)
        now, after = then, state(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
