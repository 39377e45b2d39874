"""A full-text index: posting lists in blocks with maxima, and searches that skip blocks which cannot win.

Documents are dealt into ranges by a hash of their key, about ``PER_RANGE`` to a range, and all terms use the same ranges. A row
of the index is one term in one range: its documents with term counts and lengths, the largest count and least length
among them, and how often it occurs in all. So a frequent term is many small rows instead of one long list, no key is hot, and what the terms of
a question can score together in a range is bounded by the rows' maxima, without opening them.

BM25 scores the most promising ranges of a question first; the k-th score found there is a threshold, and of all
other ranges only those whose bound reaches it are opened. Nothing is lost: a range holds all terms of its documents. A
search for all terms opens the blocks of these terms once for all questions, and looks at the documents of a question's rarest term.

The corpus is tokenised once, when the index is written. Rows are partitioned by a hash of the term, so that a search
reads the folders of its terms only (while these are few).

Cases: null and empty texts are documents without terms, and null ones do not count for the mean length; a key is taken to name one document; questions without terms
get no rows; terms that no document has match nothing; an empty table has an empty index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..storage import join_few, join_salted, written
from .search import _top, match_all, terms_of

PER_RANGE, FOLDERS = 512, 64


def _blocks_of_range(held: pa.Table) -> pa.Table:
    """The posting blocks of one range of documents (key, range, terms): all terms of it, each with its documents by key."""
    lists, keys = held.column("_t").combine_chunks(), held.column("key").combine_chunks()
    n, order = len(keys), pc.sort_indices(keys).to_numpy()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    coded = lists.flatten().dictionary_encode()
    both, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(place, size), return_counts=True)
    code, at = np.divmod(both, n)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    dl, tf = size[order][at], tf.astype(np.int64)
    docs = pa.StructArray.from_arrays([keys.take(pa.array(order[at])), pa.array(tf), pa.array(dl)], names=["key", "tf", "dl"])
    ends = np.append(first, len(both)).astype(np.int32)
    most, least, words = (f.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, dl), (np.add, tf)))
    columns = {
        "term": coded.dictionary.take(pa.array(code[first])),
        "range": pa.array(np.full(len(first), held.column("range")[0].as_py(), np.int32)),
        "docs": pa.ListArray.from_arrays(pa.array(ends), docs),
        "max_tf": pa.array(most),
        "min_dl": pa.array(least),
        "n": pa.array(np.diff(ends).astype(np.int64)),
        "words": pa.array(words),
    }
    return pa.table(columns)


def postings(docs: DataFrame, key: str, text: str = "text", ranges: int = 1) -> DataFrame:
    """term, range, docs (key, tf, dl), max_tf, min_dl, n, words. The texts are dealt out by range and cut into terms where they arrive, so
    that the blocks of a range are made in one place, and neither terms nor postings are shuffled."""
    place = F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int").alias("range")
    dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"), place).repartition("range").sortWithinPartitions("range")
    kind = docs.schema[key].dataType.simpleString()
    kinds = f"term string, range int, docs array<struct<key: {kind}, tf: bigint, dl: bigint>>, max_tf long, min_dl long, n long, words long"
    return dealt.select("key", "range", T.terms("_text").alias("_t")).groupBy("range").applyInArrow(_blocks_of_range, kinds)


def ranges_for(n_docs: int) -> int:
    return max(1, -(-n_docs // PER_RANGE))


@dataclass
class TextIndex:
    path: str
    n_docs: int
    avgdl: float | None
    schema: StructType

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df: how many documents hold it."""
        return spark.read.schema("term string, df long, words long").parquet(f"{self.path}/terms")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> TextIndex:
    """Write the index of docs under path."""
    spark, (n, with_text) = docs.sparkSession, docs.agg(F.count(F.lit(1)), F.count(text)).first()
    held = postings(docs, key, text, ranges_for(n)).withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    held.write.partitionBy("folder").parquet(f"{path}/postings")
    held = spark.read.schema(held.schema).parquet(f"{path}/postings")
    held.groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words")).write.parquet(f"{path}/terms")
    total = spark.read.schema("term string, df long, words long").parquet(f"{path}/terms").agg(F.sum("words")).first()[0] or 0
    avgdl = total / with_text if with_text else None
    spark.createDataFrame([(n, avgdl, held.schema.json())], "n_docs long, avgdl double, schema string").coalesce(1).write.parquet(f"{path}/stats")
    return TextIndex(path, n, avgdl, held.schema)


def opened(spark: SparkSession, path: str) -> TextIndex:
    """An index that was built before."""
    n, avgdl, schema = spark.read.parquet(f"{path}/stats").first()
    return TextIndex(path, n, avgdl, StructType.fromJson(json.loads(schema)))


def _read(index: TextIndex, asked: DataFrame) -> DataFrame:
    """The blocks; if few folders hold all terms asked for, of these folders only."""
    spark = asked.sparkSession
    folders = asked.select(F.explode("ts").alias("term")).select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("f")).distinct().limit(FOLDERS).collect()
    held = index.blocks(spark)
    return held if len(folders) == FOLDERS else held.filter(F.col("folder").isin([r["f"] for r in folders]))


def impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(blocks: DataFrame, terms: DataFrame, asked: DataFrame, n_docs: Column, avgdl: Column, k: int = 20, key: str = "doc_id", k1: float = 1.5, b: float = 0.75, first: int = 4) -> DataFrame:
    """query_id, key, score, rank of the k best. terms: term, df. The `first` most promising ranges give the threshold."""
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms_of(asked).join(terms.select("term", "df"), "term").select("query_id", "term", idf.alias("idf"))
    heads = blocks.select("term", "range", "n", "max_tf", "min_dl")
    bound = F.col("idf") * impact(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)
    ranges = join_salted(heads, weighted, ["term"], ["range"]).groupBy("query_id", "range").agg(F.sum(bound).alias("bound"))
    ranges = written(ranges.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))))

    def scored(some: DataFrame) -> DataFrame:
        wanted = written(some.join(weighted, "query_id").select("query_id", "range", "term", "idf"))
        # (term, range) is what blocks are keyed by; a pair that many questions want meets one block, whose rows it repeats.
        each = blocks.select("term", "range", "docs").join(wanted, ["term", "range"]).select("query_id", "idf", F.explode("docs").alias("d"))
        part = F.col("idf") * impact(F.col("d.tf"), F.col("d.dl"), avgdl, k1, b)
        return each.groupBy("query_id", F.col("d.key").alias(key)).agg(F.sum(part).alias("raw"))

    early = written(_top(scored(ranges.filter(F.col("order") <= first)), k, F.desc(F.round("raw", 6)), F.col(key)))
    kth = early.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("raw")).alias("kth"))
    # Scores are rounded to six places before they are ranked, so what comes within this of the threshold may win a tie.
    late = ranges.filter(F.col("order") > first).join(kth, "query_id", "left").filter(F.coalesce(F.col("bound") >= F.col("kth") - 2e-6, F.lit(True)))
    both = early.drop("rank").unionByName(scored(late.select("query_id", "range")))
    return _top(both.select("query_id", key, F.round("raw", 6).alias("score")), k, F.desc("score"), F.col(key))


def keyword_search(index: TextIndex, asked: DataFrame, k: int = 20, key: str = "doc_id") -> DataFrame:
    wanted = written(asked.select(F.explode("ts").alias("term")).distinct())
    met = join_few(_read(index, asked).select("term", "range", "docs"), wanted, ["term"], ["range"], "left_semi")
    return match_all(met.select("term", F.explode("docs").alias("d")).select("term", F.col("d.key").alias("key")), asked, k, key)


def bm25_search(index: TextIndex, asked: DataFrame, k: int = 20, key: str = "doc_id", **how) -> DataFrame:
    spark = asked.sparkSession
    return bm25(_read(index, asked), index.terms(spark), asked, F.lit(float(index.n_docs)), F.lit(float(index.avgdl or 1.0)), k, key, **how)
