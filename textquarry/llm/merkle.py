"""A Merkle manifest of a table, with a proof for each row, by nested-interval labels.

Every row is a leaf of its group's tree. A node carries the interval of leaf ranks that it covers, so that an ancestor of
a node is whatever node of a higher level holds its interval, and the siblings of a node are what is left of its
parent's interval without its own. The groups' roots are the leaves of one more tree.

Scale: ranks come from a range partitioning by group and order, with a row number inside a partition and the counts of
the partitions before; no group is sorted in one task. Levels are built ``LEVELS`` at a time: 256 neighbouring nodes
meet in one row, which holds all levels above them as arrays, so a billion leaves need four shuffles up, each 256
times smaller than the one before. On the way down each such row meets its ancestor by a containment join that is
bucketed by level (one row for 256 nodes moves), and hands it to its members. Only digests move, never texts.

Cases: a null in any column is a field of its own (``-``); a null group is a group, and comes first; a null order comes
first, ties are in the order of their leaves, and rows alike in all columns are leaves of their own; a table of one row
has that leaf as its root and an empty proof; an empty table gives an empty table; further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Levels that one shuffle builds.
LEVELS = 8
#: What the leaf of a document is made of, in this order (fixed values).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<digest:string,left:boolean>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that cannot be taken for another: its length in bytes, a colon, itself; a dash for null."""
    own = value.cast("string")
    return F.when(own.isNull(), "-").otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def _ranked(leaves: DataFrame) -> DataFrame:
    """leaves (tree, order, digest, any others; materialised) with pos, their rank in the tree from 0, and n, its leaves."""
    order = ["order", "digest", "_row"]
    told = leaves.withColumn("_row", F.monotonically_increasing_id())
    placed = materialise(told.repartitionByRange("tree", *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "_part", before.alias("_before"), F.sum("_n").over(tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order)) - 1
    return placed.withColumn("_place", place).join(starts, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_place")).drop("_row", "_part", "_place", "_before", "order")


def _height() -> Column:
    """Levels over the leaves of a tree of n."""
    return F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)


def _merged(level: str) -> Column:
    """The nodes over a level's: each covers the intervals of two neighbours, the last one's may be alone."""

    def over(i: Column) -> Column:
        a, b = F.get(level, 2 * i), F.get(level, 2 * i + 1)
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), digest(a["digest"], F.coalesce(b["digest"], F.lit(""))).alias("digest"))

    return F.transform(F.sequence(F.lit(0), ((F.size(level) + 1) / 2).cast("int") - 1), over)


def _blocks(nodes: DataFrame, stride: int) -> DataFrame:
    """nodes (tree, n, pos, lo, hi, digest, held) -> a row for each LEVELS levels over neighbours: l0 (the nodes) to l8."""
    node = F.struct("lo", "hi", "digest", "held")
    blocks = nodes.groupBy("tree", "n", F.shiftright("pos", LEVELS).alias("pos")).agg(F.array_sort(F.collect_list(node)).alias("l0"))
    for j in range(LEVELS):
        same = F.transform(f"l{j}", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
        blocks = blocks.withColumn(f"l{j + 1}", F.when(_height() > stride * LEVELS + j, _merged(f"l{j}")).otherwise(same))
    return blocks


def _rise(leaves: DataFrame, held: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each stride, lowest first, and the root of each tree: tree, n, pos 0, lo, hi, digest."""
    nodes = leaves.select("tree", "n", "pos", F.col("pos").alias("lo"), F.col("pos").alias("hi"), "digest", F.struct(*held).alias("held"))
    most = leaves.agg(F.max("n")).first()[0] or 1
    out = []
    for stride in range(max(1, -(-(most - 1).bit_length() // LEVELS))):
        out.append(materialise(_blocks(nodes, stride)))
        top = F.get(f"l{LEVELS}", F.lit(0))
        nodes = out[-1].select("tree", "n", "pos", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), F.struct(F.lit(True).alias("inner")).alias("held"))
    return out, nodes.drop("held")


def _siblings(i: Column, stride: int) -> Column:
    """The siblings in the block of member i and of its ancestors there: what their parents' intervals hold besides theirs."""

    def one(j: int) -> Column:
        own, parent = F.get(f"l{j}", F.shiftright(i, j)), F.get(f"l{j + 1}", F.shiftright(i, j + 1))
        alone, left = (parent["lo"] == own["lo"]) & (parent["hi"] == own["hi"]), own["lo"] > parent["lo"]
        lo = F.when(left, parent["lo"]).otherwise(own["hi"] + 1)
        at = F.shiftright(lo - F.get(f"l{j}", F.lit(0))["lo"], j + stride * LEVELS).cast("int")
        return F.struct(F.when(alone, "").otherwise(F.get(f"l{j}", at)["digest"]).alias("digest"), left.alias("left"))

    # A tree of one node has no level over it: its node stands for itself from there on.
    return F.concat(*[F.when(_height() > stride * LEVELS + j, F.array(one(j))).otherwise(F.array().cast(_PATH)) for j in range(LEVELS)])


def _members(stride: int) -> Column:
    return F.transform("l0", lambda x, i: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"), x["held"].alias("held"), _siblings(i, stride).alias("own")))


def _descend(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves with what they held, their digest and path: the siblings of all ancestors, lowest first. above (tree, pos, lo, hi,
    path, any others): the path of each tree's root."""
    carried = [c for c in above.columns if c not in ("tree", "pos", "lo", "hi", "path")]
    for stride in reversed(range(len(blocks))):
        top = F.get(f"l{LEVELS}", F.lit(0))
        lower = blocks[stride].alias("b").join(above.alias("a"), (F.col("b.tree") == F.col("a.tree")) & (F.col("b.pos") == F.col("a.pos")) & (F.col("a.lo") <= top["lo"]) & (top["hi"] <= F.col("a.hi")))
        lower = lower.select("b.*", F.col("a.path").alias("_above"), *[F.col(f"a.{c}") for c in carried])
        told = lower.select("tree", "_above", *carried, F.explode(_members(stride)).alias("m"))
        path = F.concat("m.own", "_above").alias("path")
        here = ["m.digest", "m.held"] if not stride else []
        above = told.select("tree", F.shiftright("m.lo", stride * LEVELS).alias("pos"), "m.lo", "m.hi", path, *carried, *here)
    return above.select("tree", "path", *carried, "digest", "held.*")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda made, x: F.when(x["left"], digest(x["digest"], made)).otherwise(digest(made, x["digest"])))


def proofs(leaves: DataFrame) -> DataFrame:
    """leaves (group, order, digest, any others) -> the others with leaf, subroot, root and path (digest, left; lowest first)."""
    held = [c for c in leaves.columns if c not in ("group", "order", "digest")]
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # null first, then bytewise
    ranked = materialise(_ranked(materialise(leaves.select(tree.alias("tree"), "order", "digest", *held))))
    blocks, subroots = _rise(ranked, held or ["pos"])
    over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("order"), "digest", F.col("tree").alias("name"), F.col("hi").alias("last"))
    top, roots = _rise(materialise(_ranked(materialise(over))), ["name", "last"])
    start = roots.select("tree", "pos", "lo", "hi", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    named = _descend(top, start).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("lo"), F.col("last").alias("hi"), "path", "root", F.col("digest").alias("subroot"))
    return _descend(blocks, materialise(named)).select(*held, F.col("digest").alias("leaf"), "subroot", "root", "path")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path of each document, and now: the leaf as it is after tampering with n_chars where
    `tampered` holds (the leaf itself elsewhere)."""
    leaf = digest(*[field(F.col(c)) for c in FIELDS])
    changed = digest(*[field(F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c)) for c in FIELDS])
    own = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("order"), leaf.alias("digest"), "doc_id", F.when(F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False)), changed).alias("now"))
    return proofs(own).withColumn("now", F.coalesce("now", "leaf"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_seventh = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    told = manifest(table(spark, sf_dir, "documents", *FIELDS), every_seventh).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: x["digest"]), ""), 256)
    return told.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
  CASE WHEN {_CRC32} % 7 = 0 THEN sha256({" || ".join(_field("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)}) END AS bad FROM documents),
 p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
 t AS (SELECT lang, 0 AS level, pos, leaf AS digest, n FROM p
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(digest || coalesce(lead(digest) OVER (PARTITION BY lang ORDER BY pos), '')), (n + 1) // 2 FROM t WHERE n > 1 QUALIFY pos % 2 = 0),
 r AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT 0 AS level, pos, subroot AS digest, n FROM r
  UNION ALL SELECT level + 1, pos // 2, sha256(digest || coalesce(lead(digest) OVER (ORDER BY pos), '')), (n + 1) // 2 FROM u WHERE n > 1 QUALIFY pos % 2 = 0),
 s AS (SELECT p.lang, p.pos, p.leaf, p.doc_id, t.level, 0 AS part, CASE WHEN (p.pos >> t.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(o.digest, '') AS side FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang AND t.pos = p.pos >> t.level AND t.n > 1
   LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM t.lang AND o.level = t.level AND o.pos = xor(t.pos, 1)
  UNION ALL SELECT p.lang, p.pos, p.leaf, p.doc_id, u.level, 1, CASE WHEN (r.pos >> u.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(o.digest, '') FROM p JOIN r ON p.lang IS NOT DISTINCT FROM r.lang JOIN u ON u.pos = r.pos >> u.level AND u.n > 1
   LEFT JOIN u o ON o.level = u.level AND o.pos = xor(u.pos, 1)),
 w AS (SELECT lang, pos, list(side ORDER BY part, level) AS sides FROM s GROUP BY lang, pos),
 f AS (SELECT p.doc_id, p.leaf, r.subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(sides, []::VARCHAR[]) AS sides, coalesce(bad, p.leaf) AS now FROM p JOIN r ON p.lang IS NOT DISTINCT FROM r.lang LEFT JOIN w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda x: x[2:]), '')) AS proof_sha256,
 list_reduce(list_prepend(now, sides), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root, folded_root = root AS verified FROM f
"""
