"""A cache of two tiers, in order of last use: what the first holds in bytes, what falls to the second, what is evicted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tiers(log: DataFrame, key: str, size: str, at: str, first: int, second: int, slice_seconds: int = 3600) -> DataFrame:
    """key, size, last_used, uses, before (bytes of all entries used later), tier: 1, 2 or 0 for evicted.

    log: a row a use. An entry is as large as its largest use says; the latest used come first, ties by key. A use brings an
    entry up again, as only its last one counts. Running sums go by slices of time, and inside a slice over its own
    entries, so that no task sorts the whole log.
    """
    entries = log.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(F.max(size).cast("long").alias("size"), F.max(at).alias("last_used"), F.count(F.lit(1)).alias("uses"))
    own = entries.withColumn("_slice", F.floor(F.unix_timestamp("last_used") / slice_seconds))
    later = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # over slices, not entries
    base = own.groupBy("_slice").agg(F.sum("size").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_slice").orderBy(F.desc("last_used"), key).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, "_slice")
    before = (F.col("_base") + F.col("_in")).cast("long")
    tier = F.when(before + F.col("size") <= first, 1).when(before + F.col("size") <= first + second, 2).otherwise(0)
    return placed.select(key, "size", "last_used", "uses", before.alias("before"), tier.alias("tier"))


def promoted(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The entries that rose: from the second tier, or from none, to the first."""
    old = before.select(key, F.col("tier").alias("_old"))
    return after.filter("tier = 1").join(old, key, "left").filter("_old IS NULL OR _old <> 1").select(*after.columns)
