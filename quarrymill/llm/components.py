"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: neighbours on one side of a node move to its least neighbour.

    Only group minima are aggregated, so a node with very many neighbours is combined before
    the shuffle; the join back is on the node and can be split where it is skewed.
    """
    pairs = edges.union(edges.select("b", "a").toDF("a", "b")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = pairs.join(least, "a")
    moved = joined.filter(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("x"), F.col("m").alias("y"))
    if not large:
        out = out.union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (long columns ``a`` and ``b``) the least node it reaches.

    Returns ``node`` and ``component``.  Nulls and self loops are ignored, repeated and
    reversed edges count once, an empty edge list gives no rows.  Each round is checkpointed;
    the number of rounds grows with the logarithm of the longest path.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        summary = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(summary) == before or not summary["n"]:
            break
        before = tuple(summary)
        now = checkpointed(_star(_star(now, large=True), large=False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct().toDF("node", "component"))
