"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(edges: DataFrame) -> DataFrame:
    """For each u: the least of its neighbours; combined before the shuffle, so hubs are cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (u, v) of longs -> (node, root): for every node with a link the least node it reaches.

    Every round is two joins and two aggregations over the edges, written to the shared folder;
    the edges shrink towards stars around the roots. The number of rounds grows as the logarithm
    of the longest chain. Ends when a round changes nothing.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u with smaller neighbours v and their least m gives (v, m) and (u, m).
        least = _least(large)
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
