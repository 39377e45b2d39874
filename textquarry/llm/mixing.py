"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to; only these patterns (never documents) enter the flow. A
pattern can give its words once at cost 1, a second time at cost 2 and a third time at cost 3: convex costs, so that
repeats are spread as evenly as the quotas allow. Patterns that share sources are solved together, each such component in
its own task; a pattern with one source of its own is a component by itself. Each pattern's words are then taken from
its documents in the order of a seeded digest: whole rounds first, and the rest up to the exact word in one last document.
Running totals are summed over slices of the digest first, so that a source with a third of all rows is not one group.

Cases: null text has size 0; a null source is a source (last in order); repeated rows count each; documents without
words are never taken; a table without words has targets 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, table
from .graph import components


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, most: int = 3) -> list[int]:
    """Words that each pattern (sources, size) gives, repeats counted, so that quotas are met as far as sizes allow at least cost."""
    names = list(quotas)
    end = 1 + len(patterns) + len(names)
    to, room, cost, at = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, r: int, c: int) -> None:
        for x, y, z, w in ((a, b, r, c), (b, a, 0, -c)):
            at[x].append(len(to))
            to.append(y), room.append(z), cost.append(w)

    for i, (sources, size) in enumerate(patterns):
        for level in range(1, most + 1):
            arc(0, 1 + i, size, level)
        for s in sources:
            arc(1 + i, 1 + len(patterns) + names.index(s), most * size, 0)
    for k, s in enumerate(names):
        arc(1 + len(patterns) + k, end, quotas[s], 0)
    while True:  # cheapest augmenting path (Bellman-Ford with a queue)
        best, by, queue = [None] * (end + 1), [-1] * (end + 1), deque([0])
        best[0] = 0
        while queue:
            x = queue.popleft()
            for e in at[x]:
                if room[e] and (best[to[e]] is None or best[x] + cost[e] < best[to[e]]):
                    best[to[e]], by[to[e]] = best[x] + cost[e], e
                    queue.append(to[e])
        if best[end] is None:
            break
        path, x = [], end
        while x:
            path.append(by[x])
            x = to[by[x] ^ 1]
        n = min(room[e] for e in path)
        for e in path:
            room[e] -= n
            room[e ^ 1] += n
    return [sum(room[e ^ 1] for e in at[0] if to[e] == 1 + i) for i in range(len(patterns))]


def source_targets(sizes: DataFrame, total: float, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size): a row for each source, with its target. total: words to share.

    A target is its weight's share, at most `most` times the source; what is cut off is shared by weight among the rest.
    With sources by rising ratio of limit to weight, a source is at its limit if that is at most the level which would
    hold from it on; the windows run over a row for each source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(total) - F.coalesce(F.sum("limit").over(order), F.lit(0.0))) / (F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("w"))
    rest = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("w"), "level"))).over(Window.partitionBy())["level"]
    return levels.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(rest * F.col("w")).alias("target"))


def mix(docs: DataFrame, sources: str, size: str, key: str = "doc_id", seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """docs: key, sources (array), size, any others; materialised. Returns docs with taken, and the targets by source."""
    keyed = docs.withColumn("_pattern", F.to_json(F.array_sort(F.array_distinct(sources))))
    patterns = materialise(keyed.groupBy("_pattern").agg(F.first(F.array_sort(F.array_distinct(sources))).alias("_sources"), F.sum(size).alias("_size")))
    each = patterns.select("_pattern", "_size", F.explode("_sources").alias("source"))
    total = float(patterns.agg(F.sum("_size")).first()[0] or 0)
    targets = materialise(source_targets(each.groupBy("source").agg(F.sum("_size").alias("source_size")), total, weights, most))
    names = each.select("_pattern", F.to_json(F.array("source")).alias("s"))
    grouped = components(names.join(names.select(F.col("s"), F.col("_pattern").alias("p2")).groupBy("s").agg(F.min("p2").alias("p2")), "s").select(F.col("_pattern").alias("a"), F.col("p2").alias("b")))
    quota = F.least(F.round("target"), F.col("source_size") * most).cast("long").alias("quota")
    met = each.join(targets, each["source"].eqNullSafe(targets["source"]))
    routed = met.select("_pattern", "_size", F.to_json(F.array(each["source"])).alias("s"), quota)
    routed = routed.join(grouped, F.col("_pattern") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_pattern"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        own = [(p, tuple(g["s"]), int(g["_size"].iloc[0])) for p, g in group.sort_values(["_pattern", "s"]).groupby("_pattern")]
        flow = min_cost_flow([(s, n) for _, s, n in own], {s: int(q) for s, q in sorted(zip(group["s"], group["quota"], strict=True))}, most)
        return pd.DataFrame({"_pattern": [p for p, _, _ in own], "_flow": flow})

    flows = routed.groupBy("root").applyInPandas(solve, "_pattern string, _flow long")
    rounds = F.when(F.col("_size") > 0, F.floor(F.col("_flow") / F.col("_size"))).otherwise(0).alias("_rounds")
    plan = patterns.select("_pattern", "_size").join(flows, "_pattern").select(F.col("_pattern").alias("p"), rounds, "_flow", F.col("_size").alias("_all"))
    plan = plan.select("p", "_rounds", (F.col("_flow") - F.col("_rounds") * F.col("_all")).alias("_rest"))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    ordered = keyed.withColumn("_digest", digest).withColumn("_slice", F.substring("_digest", 1, 3))
    before = Window.partitionBy("_pattern").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = ordered.groupBy("_pattern", "_slice").agg(F.sum(size).alias("_n")).select(F.col("_pattern").alias("p2"), F.col("_slice").alias("s2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_pattern", "_slice").orderBy("_digest", key, size).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = ranked.join(base, (F.col("_pattern") == F.col("p2")) & (F.col("_slice") == F.col("s2"))).join(plan, F.col("_pattern") == F.col("p"))
    extra = F.greatest(F.lit(0), F.least(F.col(size), F.col("_rest") - F.col("_base") - F.col("_in")))
    return placed.select(*docs.columns, (F.col(size) * F.col("_rounds") + extra).cast("long").alias("taken")), targets


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """key, size, source_size, target, taken for documents with one source each."""
    sized = materialise(docs.select(F.col(key), F.col(source).alias("_source"), F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")))
    taken, targets = mix(sized.withColumn("_member", F.array("_source")), "_member", "size", key, **how)
    return taken.join(targets, F.col("_source").eqNullSafe(F.col("source"))).select(key, "size", "source_size", "target", "taken")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS top, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
 l AS (SELECT *, (total - coalesce(sum(top) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY top / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, CASE WHEN top <= level * w THEN top ELSE w * (SELECT arg_min(level, top / w) FROM l WHERE top > level * w) END AS target FROM l),
 f AS (SELECT *, least(round(target), 3 * source_size)::BIGINT AS flow FROM t),
 c AS (SELECT d.doc_id, d.size, f.source_size, f.target, flow, CASE WHEN source_size > 0 THEN flow // source_size ELSE 0 END AS rounds,
   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('7|' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * rounds + greatest(0, least(size, flow - rounds * source_size - before)))::BIGINT AS taken FROM c
"""
