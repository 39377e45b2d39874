"""Near copies by five-word shingles: exact Jaccard similarity of at least ``LEAST`` per cent, for the pipeline's near-dedup stage.

SimHash (the operator's own: five-word fingerprints, deals, pivot distance tables, two bits) gives the closest pairs, which
join most copies. At similarity 0.8 about 10 of 64 bits differ, and up to 20, which no deal of fingerprints can find;
so the n-gram join looks for the links that are left between the components. Its columns are bands of minima here, as at
this threshold its blocks take more disk than the stage may use: a pair at 0.8 shares none of 36 bands of five minima with a
chance of (1 - 0.8 ** 5) ** 36, less than one in a million, and a pair above still less. Every link, from either side,
is verified on the whole sets before it counts. Rows with one set are one node; a group of copies costs a few pairs each.

Cases: null and blank texts have no shingles and are copies of each other; a text of fewer than five words is one
shingle; rows without a key take part; rows are told apart by all their columns, so repeated keys are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise, row_digest
from .jaccard import links
from .simhash import close_pairs

WORDS, LEAST, BANDS = 5, 80, (36, 5)


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes with one fingerprint (the least of them with each other), or with fingerprints that SimHash links."""
    nodes = rows.filter("node IS NOT NULL").select("fp", "node").distinct()
    low = materialise(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    same = join_hot(nodes, low, ["fp"], ["node"]).filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    linked = close_pairs(low.select("fp"))
    for k in ("a", "b"):
        linked = linked.join(low.select(F.col("fp").alias(k), F.col("low").alias(f"_{k}")), k)
    return same.unionByName(linked.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (the row's digest), component: rows that links join, however far, have one component (null: no words)."""
    told = docs.select(F.struct(F.col(key).alias("key"), row_digest(docs).alias("row")).alias("_key"), F.col(text).alias("text"))
    rows, roots = links(told, "_key", "text", WORDS, LEAST, fingerprint_pairs, BANDS)
    held = rows.select(F.col("key.key").alias(key), F.col("key.row").alias("row"), "node")
    labelled = join_hot(held, roots, ["node"], ["row"], "left")
    return labelled.select(key, "row", F.coalesce("root", "node").alias("component"))
