"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import materialise


def _followed(moves: DataFrame) -> DataFrame:
    """(node, to) with every pointer followed to its end, in steps that double; each pass takes four times as far as the one before."""
    while True:
        once = moves.select(F.col("node").alias("to"), F.col("to").alias("far"))
        twice = moves.join(once, "to").select("node", F.col("far").alias("to"))
        ahead = twice.select(F.col("node").alias("to"), F.col("to").alias("far"))
        moves = materialise(twice.join(ahead, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("on")), "moves")
        ended = moves.where("on").isEmpty()
        moves = moves.drop("on")
        if ended:
            return moves


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in `links` (a, b): root is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, or at itself if that is larger, follows these pointers to
    their ends, and renames the links so; links within one end vanish and equal ones fall together. Each round at least
    halves the nodes that still have links, and a chain takes one. Minima are summed before the shuffle, so a hub is no
    bottleneck. The state is written to the shared folder in each round.
    """
    left = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    roots = None
    while True:
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = materialise(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "moves")
        moves = _followed(moves)
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(moves.withColumnRenamed("node", "at"), F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = materialise(roots, "roots")
        of_a, of_b = moves.select(F.col("node").alias("a"), F.col("to").alias("ta")), moves.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        renamed = left.join(of_a, "a").join(of_b, "b").where("ta <> tb")
        left = materialise(renamed.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "links")
        if left.isEmpty():
            return roots
