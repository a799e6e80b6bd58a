"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation (the least neighbour of every node, combined before the shuffle) and an equi-join back to
the links, so a hub with very many links is split by the adaptive skew join instead of being gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _both(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node is linked to the node's least neighbour (or itself).  small: the node
    and its smaller neighbours are."""
    around = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = around.join(least, around.a == least.n)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> (node, component): each node that has a link, with the least node it can reach.

    Links of a node to itself and links with a null say nothing.  Ends when a pair of steps changes no link; the
    number of steps grows with the logarithm of the longest path.  Raises if ``rounds`` do not suffice.
    """
    now = shared.written(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        nxt = shared.written(_star(_star(now, True), False), "links")
        got = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_if(F.col("a") < F.col("b")).alias("x")).first()
        shared.drop(now)
        now, old, seen = nxt, seen, tuple(got)
        if old == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._quarry_path = now._quarry_path
    return out
