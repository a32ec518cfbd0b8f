"""Connected components by alternating star contractions, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import checkpoint


def _count(edges: DataFrame) -> tuple[int, int]:
    """Number of the (distinct) edges and the exclusive-or of their hashes, which no number of edges can overflow."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``node, root``: every linked node with the smallest node it can reach.

    A round sends each node's larger neighbours to its smallest one, then each node's smaller neighbours to
    their smallest (large and small star). Rounds repeat until nothing changes; their number grows with the
    logarithm of the longest path. Minima are pre-aggregated before the shuffle, and what they join is an equi-join
    whose skewed partitions the runtime can split, so a hub is no hot task. Loops and null ends are left out.
    """
    edges = checkpoint(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _count(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        # of each edge the larger end goes to the smallest node around the smaller end
        large = edges.join(low, edges["b"] == low["n"]).select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = large.join(low, large["a"] == low["n"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(moved.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        now = _count(edges)
        if now == seen:
            break
        seen = now
    # settled edges are stars around the smallest node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
