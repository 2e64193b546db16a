"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

The number of rounds grows with the logarithm of the longest chain. The edges of each round are
written to the shared folder, so lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1_000_000_007)), F.lit(0))).first()
    return row[0], row[1]


#: A node with more neighbours than this is a hub. There are at most 2 / HUB as many hubs as edges.
HUB = 100_000


def _with_least(edges: DataFrame, least: DataFrame, may_have_hubs: bool) -> DataFrame:
    """(a, b, m): edges with the least neighbour m of a. ``least`` is (a, m, n), n neighbours.

    The edges of a hub stay where they are, as the few hubs are broadcast; the others meet in a shuffle, HUB to a node at most.
    """
    m = least.select("a", "m")
    if not may_have_hubs:
        return edges.join(m, "a")
    hubs = cut(least.filter(F.col("n") > HUB).select("a", F.col("m").alias("hub_m")))
    told = edges.join(F.broadcast(hubs), "a", "left")
    rest = told.filter("hub_m is null").select("a", "b").join(least.filter(F.col("n") <= HUB).select("a", "m"), "a")
    return told.filter("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, may_have_hubs: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.filter("b > a"), least, may_have_hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, may_have_hubs: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    kept = _with_least(down, least, may_have_hubs).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, undirected, to ``(node, component)``; component is the least node.

    Self loops, repeated and null-ended edges are ignored; an empty table gives an empty one.
    """
    edges = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # no node has more neighbours than there are edges
        hubs = mark[0] > HUB
        edges = cut(_small_star(cut(_large_star(edges, hubs)) if hubs else _large_star(edges, hubs), hubs))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
