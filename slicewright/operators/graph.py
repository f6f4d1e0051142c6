"""Connected components of a graph by alternating stars: each round hangs nodes on the least one they know of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.session import discard, materialize


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges ``a > b``: the larger (or else smaller) neighbours of each node hang on the least of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of ``edges(a, b)``: the component is its least node. Nodes without an edge to another are not in it.

    Stars take a number of rounds that grows with the logarithm of the largest component, whatever its diameter; a
    hub is met by a join, never gathered. Edges with a null are ignored.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        new = materialize(_round(_round(now, True), False), "stars")
        changed = not new.join(now, ["a", "b"], "left_anti").isEmpty() or not now.join(new, ["a", "b"], "left_anti").isEmpty()
        discard(spark, [now])
        now = new
        if not changed:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
