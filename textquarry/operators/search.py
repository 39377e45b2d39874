"""Filters, dense, keyword and hybrid retrieval, BM25, rerank. Questions are a table of any size: query_id, qv (vector), ts (terms)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import join_few, join_salted, written


def metadata_filter(df: DataFrame, filters: dict, match: str = "all") -> DataFrame:
    """A conjunction of equalities. None is skipped; a list means any of them for a scalar column, all (or any) of them for an array."""
    cond: Column = F.lit(True)
    for name, value in filters.items():
        if value is None or value == []:
            continue
        is_array = df.schema[name].dataType.typeName() == "array"
        many = list(value) if isinstance(value, list | tuple) else [value]
        if is_array:
            each = [F.array_contains(name, v) for v in many]
            one = each[0]
            for e in each[1:]:
                one = (one & e) if match == "all" else (one | e)
        else:
            one = F.col(name).isin(many)
        cond = cond & one
    return df.filter(cond)


def request_filters(asked: dict) -> dict:
    """A request's filters under the columns' names; empty ones are dropped."""
    names = {"file_type": "doc_type", "document_ids": "doc_id"}
    return {names.get(k, k): v for k, v in asked.items() if v}


def _top(df: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k of each query: Spark keeps k rows of each task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col(rank) <= k)


def questions(spark: SparkSession, asked: list[tuple]) -> DataFrame:
    """A batch of questions (id, vector, terms) as a table; vector and terms may be None."""
    rows = [(int(q), None if v is None else [float(x) for x in v], None if ts is None else [t.lower() for t in ts]) for q, v, ts in asked]
    return spark.createDataFrame(rows, "query_id long, qv array<double>, ts array<string>")


def _best_of_block(rows: pd.DataFrame, asked: pd.DataFrame, k: int, least: float | None, others: bool, key: str) -> pd.DataFrame:
    """The k best of a block of rows for each of a block of questions: a product of matrices, some questions at a time."""
    out = []
    if len(rows) and len(asked):
        ids = rows["_key"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.stack(rows["_v"].to_numpy()[order]).astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        for at in range(0, len(asked), 64):
            some = asked.iloc[at : at + 64]
            q = np.stack(some["qv"].to_numpy()).astype(np.float64)
            both = np.sqrt((q * q).sum(axis=1))[:, None] * size[None, :]
            score = np.round(np.divide(q @ x.T, both, out=np.zeros_like(both), where=both != 0), 6)
            for question, own in zip(some["query_id"].tolist(), score, strict=True):
                fit = np.ones(len(own), bool) if least is None else own >= least
                if others:
                    fit &= ids != question
                fit = np.flatnonzero(fit)
                if len(fit) > k:
                    fit = fit[own[fit] >= np.partition(own[fit], len(fit) - k)[len(fit) - k]]
                best = fit[np.argsort(-own[fit], kind="stable")][:k]  # rows are in order of their keys, so ties are too
                out.append(pd.DataFrame({"query_id": question, key: ids[best], "score": own[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "score": []})


def dense_search(
    vectors: DataFrame,
    asked: DataFrame,
    k: int = 20,
    key: str = "chunk_id",
    vector: str = "embedding",
    least: float | None = None,
    others: bool = False,
    block_rows: int = 50_000,
    block_questions: int = 4_096,
) -> DataFrame:
    """Exact cosine top-k: query_id, key, score, rank. asked: query_id, qv; others: a question's own key is no answer.

    Rows and questions are dealt into blocks by hash; each pair of blocks is one task's work, which leaves k rows a
    question, and these are merged. Rows without a vector, or with one of another length, never meet.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    held = asked.filter("qv IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv"))
    n_rows, n_asked = (max(1, -(-df.count() // size)) for df, size in ((rows, block_rows), (held, block_questions)))
    place = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = rows.select("*", F.size("_v").alias("_n"), F.pmod(F.xxhash64("_key"), F.lit(n_rows)).cast("int").alias("_a"), F.explode(place(n_asked)).alias("_b"))
    held = held.select("*", F.size("qv").alias("_n"), F.explode(place(n_rows)).alias("_a"), F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int").alias("_b"))
    kind = vectors.schema[key].dataType.simpleString()
    blocks = rows.groupBy("_n", "_a", "_b").cogroup(held.groupBy("_n", "_a", "_b"))
    found = blocks.applyInPandas(lambda r, q: _best_of_block(r, q, k, least, others, key), f"query_id long, `{key}` {kind}, score double")
    return _top(found, k, F.desc("score"), F.col(key))


def terms_of(asked: DataFrame) -> DataFrame:
    """query_id, term, terms (how many the question has)."""
    own = asked.select("query_id", F.array_distinct("ts").alias("_ts"))
    return own.select("query_id", F.explode("_ts").alias("term"), F.size("_ts").alias("terms"))


def match_all(hits: DataFrame, asked: DataFrame, k: int = 20, key: str = "chunk_id") -> DataFrame:
    """Documents that hold all terms of asked (query_id, ts), in order of their keys, score 1. hits: key, term, for all terms
    asked for.

    A document's terms are gathered once; a question looks at the documents of its rarest term only, and no pair of a
    question and a document is shuffled before all terms are found in it.
    """
    held = written(hits.groupBy("key").agg(F.collect_set("term").alias("held")))
    df = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = terms_of(asked).join(df, "term").groupBy("query_id", "terms").agg(F.min(F.struct("df", "term")).alias("least"), F.collect_list("term").alias("all"))
    leads = written(own.filter(F.size("all") == F.col("terms")).select("query_id", F.col("least.term").alias("term"), "all"))
    met = join_few(held.select("key", "held", F.explode("held").alias("term")), leads, ["term"], ["key"])
    found = met.filter(F.forall("all", lambda t: F.array_contains("held", t))).select("query_id", F.col("key").alias(key))
    return _top(found.withColumn("score", F.lit(1.0)), k, F.col(key))


def keyword_search(docs: DataFrame, asked: DataFrame, k: int = 20, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Documents that hold all terms, in order of their keys, score 1. asked: query_id, ts. One pass over the texts."""
    wanted = written(asked.select(F.explode("ts").alias("term")).distinct())
    own = docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(T.terms(text))).alias("term"))
    return match_all(join_few(own, wanted, ["term"], ["key"], "left_semi"), asked, k, key)


def fuse(dense: DataFrame, keyword: DataFrame, k: int = 20, dense_weight: float = 0.7, keyword_weight: float = 0.3, constant: int = 60, key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal-rank fusion; ties keep dense before keyword order; rounded after sorting."""
    a = dense.select("query_id", key, F.col("rank").alias("dr"))
    b = keyword.select("query_id", key, F.col("rank").alias("kr"))
    both = a.join(b, ["query_id", key], "full_outer")
    raw = F.coalesce(dense_weight / (constant + F.col("dr")), F.lit(0.0)) + F.coalesce(keyword_weight / (constant + F.col("kr")), F.lit(0.0))
    top = _top(both.withColumn("raw", raw), k, F.desc("raw"), F.asc_nulls_last("dr"), F.asc_nulls_last("kr"))
    return top.select("query_id", key, F.round("raw", 6).alias("score"), "rank", "dr", "kr")


def hybrid_search(vectors: DataFrame, docs: DataFrame, asked: DataFrame, k: int = 20, key: str = "chunk_id", **weights) -> DataFrame:
    return fuse(dense_search(vectors, asked, 3 * k, key), keyword_search(docs, asked, 3 * k, key), k, key=key, **weights)


def retrieve(mode: str, vectors: DataFrame, docs: DataFrame, asked: DataFrame, k: int = 20, key: str = "chunk_id") -> DataFrame:
    """dense, keyword, or anything else: hybrid. Questions without terms are skipped."""
    asked = asked.filter(F.coalesce(F.exists("ts", lambda t: T.strip(t) != ""), F.lit(False)))
    if mode == "dense":
        return dense_search(vectors, asked, k, key)
    if mode == "keyword":
        return keyword_search(docs, asked, k, key)
    return hybrid_search(vectors, docs, asked, k, key).drop("dr", "kr")


def more_like_this(vectors: DataFrame, asked: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The rows nearest to rows (query_id, qv), other than those."""
    return dense_search(vectors, asked, k, key, others=True)


def rerank(found: DataFrame, n: int, score: Column | None = None) -> DataFrame:
    """The first n by score (as they are without one), ranked anew; the score before stays as original_score."""
    own = found.withColumn("original_score", F.col("score"))
    if score is not None:
        own = own.withColumn("score", score)
        return _top(own, n, F.desc("score"), F.col("rank"), rank="new_rank").withColumn("rank", F.col("new_rank")).drop("new_rank")
    return own.filter(F.col("rank") <= n)


def bm25(docs: DataFrame, asked: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25 (an extension). asked: query_id, ts. Only the questions' terms are counted by document; the statistics of
    the corpus are two numbers, and ride along with the counts of terms."""
    wanted = asked.select("query_id", F.explode(F.array_distinct("ts")).alias("term"))
    held = docs.select(F.col(key), T.terms(text).alias("_t"))
    sizes = held.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("_t")).alias("avgdl"))
    tf = held.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(sizes))  # one row
    s = join_salted(tf, df.join(wanted, "term"), ["term"], [key])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _top(s.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score")), k, F.desc("score"), F.col(key))
