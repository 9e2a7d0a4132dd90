"""Connected components of an edge table by repeated contraction; no edge or label ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.sources.shared import discard, stored


def _order(node: Column, turn: int) -> Column:
    """Order in which nodes win in a round: their number first (stars fall together at once), then by a new hash each time."""
    return node if turn == 0 else F.xxhash64(node, F.lit(turn))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long).

    Each round points every node at the least of itself and its neighbours and replaces edges by edges between those.
    The order is hashed anew each round, so the number of rounds grows with the logarithm of the longest path.
    Self-loops and repeated edges are allowed; nodes without an edge to another node do not appear.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, hops = None, []
    turn = 0
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = F.struct(_order(F.col("a"), turn).alias("o"), F.col("a").alias("n"))
        best = both.groupBy("a").agg(F.min(F.struct(_order(F.col("b"), turn).alias("o"), F.col("b").alias("n"))).alias("near"))
        hop = stored(best.select(F.col("a").alias("node"), F.least(own, F.col("near"))["n"].alias("to")), "hop")
        if labels is None:
            labels = hop.select("node", F.col("to").alias("component"))
        else:
            nxt = hop.select(F.col("node").alias("component"), "to")
            labels = labels.join(nxt, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        hops.append(hop)
        ends = left.join(hop.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hop.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        last, left = left, stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(last)
        turn += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    done = stored(labels, "components")
    discard(left, *hops)
    return done
