"""What an assistant may call: search, a document, its content for a summary, an analysis of the collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import join_few, written

MOST_RESULTS, RESULT_CHARS, PREVIEW_CHARS, CONTENT_CHARS = 20, 800, 2000, 8000


def search_results(found: DataFrame, docs: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """Ranked rows with the start of their text; never more than 20 of a query."""
    own = written(found.filter(F.col("rank") <= min(max(k, 1), MOST_RESULTS)))
    starts = docs.select(key, F.substring("text", 1, RESULT_CHARS).alias("text"))
    held = join_few(starts, own.select(key).distinct(), [key], [key], "left_semi")  # only texts that were found move
    return own.join(held, key, "left").select("query_id", key, "rank", F.round("score", 4).alias("score"), F.coalesce("text", F.lit("")).alias("text"))


def document(docs: DataFrame, by_id=None, name: str | None = None, key: str = "doc_id", filename: str = "filename") -> DataFrame:
    """The document with an id, or the first by id whose name holds a string."""
    if by_id is None and not name:
        raise ValueError("give an id or a name")
    own = docs.filter(F.col(key) == F.lit(by_id)) if by_id is not None else docs.filter(F.col(filename).ilike(f"%{name}%")).orderBy(key).limit(1)
    return own.withColumn("preview", F.substring("text", 1, PREVIEW_CHARS))


def analysis(docs: DataFrame, chunks: DataFrame, **by: str) -> DataFrame:
    """metric, value, n: documents and chunks in all, and documents by each column given (name=column)."""
    count = F.count(F.lit(1)).alias("n")
    parts = [df.agg(count).select(F.lit(m).alias("metric"), F.lit("").alias("value"), "n") for m, df in (("documents", docs), ("chunks", chunks))]
    for m, c in by.items():
        named = F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("Unknown"))
        parts.append(docs.groupBy(named.alias("value")).agg(count).select(F.lit(m).alias("metric"), "value", "n"))
    return reduce(DataFrame.unionByName, parts)
