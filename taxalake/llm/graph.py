"""Connected components of a graph given as edges, by alternating stars.

Each round links every node's larger neighbours to its smallest neighbour, then every
node's smaller neighbours to the smallest of them. A round is two grouped minima and two
joins, so a node with very many edges is never gathered in one place. The graph
becomes a set of stars, whose centres are the components' smallest nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (long columns a, b). About the
    square of the logarithm of a component's size is needed of ``rounds``; an unfinished graph is an error."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = common.durable(ordered), None
    for _ in range(rounds):
        around = _both(now)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = common.durable(small.where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())
