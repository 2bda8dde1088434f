"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): link every v of a u to the least of u and its v's; only joins and partial sums, so no neighbour list is gathered."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("m", "u").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the least node of the component.

    Each round is written to the shared folder.  The number of rounds grows
    with the logarithm of the longest shortest path.  Self-loops and repeated
    edges are allowed; nulls are not linked; without edges the result is empty.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, before = table(state, "components"), None
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        state = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        state = table(state.where("a <> b").distinct(), "components")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = state.select("b").distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("label")))
