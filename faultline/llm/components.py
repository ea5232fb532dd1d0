"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before its shuffle) and a join that
adaptive execution splits at hub nodes.  Each round is written to the shared folder, so
lost executors cost a round at most.  The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace

#: Rounds after which a result that still changes is an error.
ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large: each node's greater neighbours move to its least; small: its lesser ones do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, place: Workspace, name: str = "components") -> DataFrame:
    """(node, component): the least node that each linked node reaches; links: (a, b) of long, in either order, with repeats."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = place.table(f"{name}-0", edges)
    seen = None
    for k in range(1, ROUNDS):
        edges = place.table(f"{name}-{k}", _star(_star(edges, True), False))
        place.drop(f"{name}-{k - 1}")
        # a star has its centre as every edge's lesser end, and no centre has an edge to a lesser one
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
    raise RuntimeError("components did not settle")
