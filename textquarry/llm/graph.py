"""Connected components by alternating large-star and small-star steps: no driver state, no iteration over nodes.

Cases: an edge from a node to itself, a repeated edge and an edge both ways change nothing; edges with a null are left
out; an empty table gives an empty table. A node that most edges share is no hot key: its edges carry a salt, and its
least neighbour, found by partial minima, is sent to just the salts that occur. The number of rounds is not limited; it
grows with the logarithm of the number of nodes, as each step at least halves the longest chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, forget, materialise, salt_bits, salted, salts_of


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u."""
    marked = edges.withColumn("salt", salted(SALTS, "v"))
    low = marked.groupBy("u").agg(F.min("v").alias("m"), salt_bits(F.col("salt")).alias("bits")).select("u", "m", salts_of(F.col("bits")).alias("salt"))
    return marked.join(low, ["u", "salt"]).drop("salt")


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
    told = _with_least(large)
    moved = told.filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return moved.unionByName(told.filter("v = m").select("u", "v")).distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges (a, b) -> (node, root), root being the smallest node of the component; for every node that has an edge to another.

    After `rounds` steps at most, if given: then nodes with one root are of one component, but one may still have several roots.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    held = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, done = mark(held), 0
    while before[0] and done != rounds:
        new = materialise(_step(held))
        forget(held)
        held, after = new, mark(new)
        if after == before:
            break
        before, done = after, done + 1
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return out if rounds is None else out.groupBy("node").agg(F.min("root").alias("root"))
