"""Connected components of an undirected graph, as DataFrame joins.

Alternates the two star steps: every node points its larger neighbours at its
smallest neighbour, then its smaller ones. Both steps keep the number of links at
or below the start, and hub nodes cost one aggregated row each, so a component
with a third of all nodes is not gathered in one task. The smallest neighbours are
written before they are joined, so that the join of a hub's links stands between two
shuffles and adaptive execution can split it. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _min_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b), any order, repeats and loops allowed, of an orderable
    type. Returns (node, component) with the smallest node of each component, one
    row per node that occurs. No edges give no rows."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stored(pairs, "links")
    before = None
    while True:  # until a round changes nothing; links only ever move to smaller nodes
        # Large star: over both directions, each neighbour above u goes to u's minimum.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(_min_neighbour(both).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = stored(_min_neighbour(large), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(small, "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
