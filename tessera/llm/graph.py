"""Connected components by alternating star joins: every round is joins and aggregates on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _minimum(pairs: DataFrame) -> DataFrame:
    """For every node u of pairs (u, v): the least of u and its neighbours, and its number of pairs."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _with_minimum(pairs: DataFrame, of: DataFrame, few: bool) -> DataFrame:
    """``pairs`` with the minimum of u among ``of``; a hub's pairs are never one task's alone."""
    least = _minimum(of)
    if few:
        return pairs.join(F.broadcast(least), "u").drop("n")
    least, path = shared.replaced(least, "minima", None)
    return shared.joined_evenly(pairs, least, "u")


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """Node and the least node of its component, for every node that an edge (a, b) has.

    Large-star joins each greater neighbour to the least one, small-star does so for the lesser
    ones; the edges shrink to one star for each component in about log(n) rounds. Each round is
    written to the shared folder, and the round before goes. Loops and repeated edges are allowed; no
    edges give no rows. Of up to ``few`` edges (counted) the minima, 24 bytes each, are broadcast.
    """
    a, b = F.col("a"), F.col("b")
    edges, path = shared.replaced(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges", None)
    state = _state(edges)
    while state[0]:
        small_enough = state[0] <= few
        both = edges.select(a.alias("u"), b.alias("v")).union(edges.select(b.alias("u"), a.alias("v")))
        large = _with_minimum(both, both, small_enough).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large, between = shared.replaced(large, "edges", None)
        down = large.select(a.alias("u"), b.alias("v"))
        lesser = down.union(down.select("u", F.col("u").alias("v")))
        small = _with_minimum(lesser, down, small_enough).filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        edges, path = shared.replaced(small, "edges", path)
        shared.remove_written(edges.sparkSession, [between])
        state, before = _state(edges), state
        if state == before:
            break
    # Every edge now leads from a node to the root of its star.
    return edges.select(a.alias("node"), b.alias("root")).union(edges.select(b, b)).distinct()
