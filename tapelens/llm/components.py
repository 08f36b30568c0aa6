"""Connected components by alternating star contractions over stored edge tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(edges: DataFrame, folder: str, name: str, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest node around it.

    ``edges`` is a stored table (a, b) of different nodes. A large star moves the larger
    neighbours, a small star the smaller ones and the node itself. The smallest neighbour is an
    aggregate, so a hub sends one row per task; the join back is of two stored tables, whose
    large partitions the engine splits.
    """
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), folder, f"{name}-least")
    joined = both.join(least.select(F.col("node").alias("a"), F.least("node", "low").alias("low")), "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return stored(moved.where("a <> b").distinct(), folder, f"{name}-edges")


def fingerprint(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Stored edges (a, b) of longs -> (node, root): root is the smallest node of the component.

    Only nodes with an edge appear. Rounds go on until an edge table repeats itself, a number that
    grows with the logarithm of the table; each round is read from files in ``folder``.
    """
    before, k = fingerprint(edges), 0
    while before[0]:
        edges = star(edges, folder, f"round{k}-large", large=True)
        edges = star(edges, folder, f"round{k}-small", large=False)
        now, k = fingerprint(edges), k + 1
        if now == before:
            break
        before = now
    roots = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
