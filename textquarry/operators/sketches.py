"""Mergeable sketches by day: distinct counts and quantiles that are stored once and merged for any span of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bits of a distinct-count sketch: its standard error is 1.04 / 2 ** (bits / 2), 1.6 % for 12.
BITS = 12


def daily(events: DataFrame, at: str, who: str, value: str) -> DataFrame:
    """day, n, who_sketch, value_sketch: a row a day, small whatever the number of events."""
    held = events.filter(F.col(at).isNotNull())
    return held.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(who), BITS).alias("who_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("value_sketch"))


def merged(days: DataFrame, *by) -> DataFrame:
    """n, distinct (estimate) and the quartiles of all days of each `by`, from the sketches alone."""
    g = days.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("who_sketch").alias("_who"), F.kll_merge_agg_double("value_sketch").alias("_value"))
    quartile = [F.kll_sketch_get_quantile_double("_value", F.lit(q)).alias(name) for q, name in ((0.25, "low"), (0.5, "median"), (0.75, "high"))]
    names = [c for c in g.columns if c not in ("n", "_who", "_value")]
    return g.select(*names, "n", F.hll_sketch_estimate("_who").alias("about"), *quartile)
