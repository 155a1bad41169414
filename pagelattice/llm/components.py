"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star: a node has one edge to a smaller node, or edges to larger ones only."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(u, v); a component is named by its least node.

    Alternates large-star and small-star until each component is a star around its
    least node.  A node with many neighbours is only ever aggregated with map-side
    partials or joined, so no task holds all its edges.  Each round is a table in the
    shared folder.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.table(edges, "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = scratch.table(_small(_large(edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))


def forest_roots(parents: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of parents(node, component), in which a node has at most one parent, a smaller one: its root.

    Each round doubles the way up, so there are as many as the logarithm of the depth; the number of
    nodes that moved is observed while a round is written.
    """
    now = scratch.table(parents, "parents")
    for _ in range(rounds):
        seen = Observation()
        above = now.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        new = now.join(above.hint("merge"), "component", "left").select("node", F.coalesce("_up", "component").alias("component"), F.col("_up").isNotNull().alias("_moved"))
        new = scratch.table(new.observe(seen, F.count_if("_moved").alias("moved")).drop("_moved"), "parents")
        if not seen.get["moved"]:
            return now
        now = new
    raise RuntimeError("the parents have a cycle")
