"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize


def _least_neighbour(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Smallest neighbour per node. The sum with 0 hides the partitioning, so that a join exchanges both
    sides; only then can the runtime split the partition of a node with very many links."""
    low = edges.groupBy(F.col(node).alias("_n")).agg(F.min(other).alias("_low"))
    return low.select((F.col("_n") + F.lit(0).cast("long")).alias("_n"), "_low")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every component is one node with all others linked to it alone: no node has two smaller
    neighbours, or smaller and larger ones."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("hi").alias("n"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")),
        F.struct(F.col("lo").alias("n"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")),
    )))
    counts = ends.groupBy("n").agg(F.sum("smaller").alias("smaller"), F.sum("larger").alias("larger"))
    return counts.where("smaller > 1 or (smaller > 0 and larger > 0)").agg(F.count("*")).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of long): root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours to
    the smallest, and writes the edges; rounds grow with the logarithm of the longest chain, and none is made
    of links that are stars already. Loops are ignored; nodes without a link to another node are absent.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = materialize(edges, "links")
    while not _all_stars(edges):
        both = edges.union(edges.select("lo", "hi")).toDF("n", "m")
        low = _least_neighbour(both, "n", "m")
        large = both.join(low, both["n"] == low["_n"]).where("m > n").select(
            F.col("m").alias("hi"), F.least("n", "_low").alias("lo")
        ).distinct()
        low = _least_neighbour(large, "hi", "lo")
        joined = large.join(low, large["hi"] == low["_n"])
        pairs = F.array(F.struct(F.col("hi").alias("x"), F.col("_low").alias("y")), F.struct(F.col("lo").alias("x"), F.col("_low").alias("y")))
        small = joined.select(F.inline(pairs)).where("x <> y").select(F.col("x").alias("hi"), F.col("y").alias("lo")).distinct()
        edges = materialize(small, "links")
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
