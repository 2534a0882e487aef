"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of ``links`` (a, b).

    In each round every node points at its smallest neighbour, the links are carried over to the nodes pointed
    at, and what has become a loop is gone; a star is done in one round, a path in about log rounds.
    Minima are combined on the map side and both joins deal their own sides, so a node with very
    many links is split. Each round is written to the shared folder. Loops and repeated links do no harm.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        # The smaller of a node's own name and its smallest neighbour.
        point = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                       .select("node", F.least("node", "least").alias("to")))
        rounds.append(point)
        to_a, to_b = point.select(F.col("node").alias("a"), F.col("to").alias("x")), point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(to_a, "a").join(to_b, "b")
        links = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1].withColumnRenamed("to", "component")
    for point in reversed(rounds[:-1]):
        up = found.withColumnRenamed("node", "to")
        found = stored(point.join(up, "to", "left").select("node", F.coalesce("component", "to").alias("component")))
    return found
