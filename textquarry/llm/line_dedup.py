"""Site-relative line dedup in DataFrame functions alone.

The documents of a host that contain a line, divided by all documents of that host, give the line's ratio; lines above
``ratio`` on at least ``min_pages`` documents are boilerplate there and go (on a host of fewer documents than 1 / ratio any
line at all is above the ratio). Lines are compared by their digest after
trimming blanks; blank lines always stay. With ``once``, exact copies of a text count as one document of their host, both
in a line's pages and in the host's total, so that a text is not boilerplate just because it is copied often; op1's SQL
counts every document.

Scale: counts are partial before the shuffle, which carries digests and hosts only. The rows that hold boilerplate are
found by a join on (host, digest, salt): the boilerplate side has few rows for each host (lines per document / ratio at
most) and is repeated for each salt, so that a line on a third of all documents spreads over ``salts`` tasks. Texts move
at most once, to meet their own lines to drop.

Cases: null text stays null and counts as a document of its host; a null host is a host of its own; null or repeated
ids are harmless (lines to drop are gathered by id and host, and a line is boilerplate for a host as a whole); an empty
text has one blank line; a text all of whose lines go becomes empty; very long texts are split whole; an empty table gives
an empty table; further columns stay, whatever their names, but n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, join_hot, quoted, table

_BLANK = " \t\r"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(_BLANK))))


def _host(host: str) -> Column:
    """A host as a key that equals itself, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.075, min_pages: int = 5, once: bool = False) -> DataFrame:
    """host (as a key), line (digest), pages: the lines to drop. once: copies of a text count as one page."""
    told = docs.select(_host(host).alias("host"), F.col(text).alias("text"))
    if once:
        told = told.withColumn("digest", F.md5("text")).dropDuplicates(["host", "digest"])
    lines = told.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _digest))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter((F.col("pages") >= min_pages) & (F.col("line") != _digest(F.lit(""))))
    hosts = told.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    joined = join_hot(counts, hosts, ["host"], ["line"])
    return joined.filter(F.col("pages") > F.lit(ratio) * F.col("all_pages")).select("host", "line", "pages")


def drop_lines(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", ratio: float = 0.075, min_pages: int = 5, salts: int = 16, once: bool = False) -> DataFrame:
    """docs without their hosts' boilerplate lines; n_lines and n_dropped tell how many there were and went."""
    each_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    bad = boilerplate(docs, host, text, ratio, min_pages, once).select("host", "line", each_salt)
    salt = F.pmod(F.xxhash64(key, F.length(text)), F.lit(salts)).cast("int")
    held = docs.select(F.col(key).alias("key"), _host(host).alias("host"), salt.alias("salt"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), _digest))).alias("line"))
    k, h, d = free_name(docs, "key", "host", "drop")
    drop = held.join(bad, ["host", "line", "salt"], "left_semi").groupBy(F.col("key").alias(k), F.col("host").alias(h)).agg(F.collect_set("line").alias(d))
    joined = docs.join(drop, docs[key].eqNullSafe(F.col(k)) & (_host(host) == F.col(h)), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(d), _digest(x)))
    some = F.col(d).isNotNull()
    new = F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return joined.select(
        *[new.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(some, n - F.size(kept)).otherwise(0).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    out = drop_lines(docs)
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 h AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
 p AS (SELECT source, trim(line, ' ' || chr(9) || chr(13)) AS t, count(DISTINCT doc_id) AS pages FROM l GROUP BY ALL),
 bad AS (SELECT p.source, p.t FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source WHERE p.t <> '' AND pages >= 5 AND pages > 0.075::DOUBLE * n),
 k AS (SELECT l.*, bad.t IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line, ' ' || chr(9) || chr(13)) = bad.t),
 d AS (SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT documents.doc_id, documents.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
 CASE WHEN text IS NULL THEN NULL ELSE length(kept) END::BIGINT AS kept_chars, CASE WHEN text IS NULL THEN NULL ELSE md5(kept) END AS kept_md5
FROM documents LEFT JOIN d USING (doc_id)
"""
