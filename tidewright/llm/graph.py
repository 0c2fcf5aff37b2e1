"""Connected components of a graph of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import materialise


def _smaller(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each neighbour v of u, and the least of u and its neighbours, one row a node.

    The least ones are written first: then both sides of the join are exchanges under a sort, and adaptive execution deals a node with very many neighbours to several tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return pairs.join(materialise(least, "least"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b) of any ordered type: the component is its least node; loops are dropped.

    Stars alternate: every node links its larger neighbours to its least one, then its smaller neighbours and itself, until nothing
    changes. Each step is an aggregation and a join with one row a node on one side; each result is written, so no lineage grows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        edges = materialise(edges, "edges")
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smaller(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _smaller(large)
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
