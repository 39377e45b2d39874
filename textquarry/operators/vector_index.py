"""An inverted-file index of vectors: lists about k-means centroids, written as partitions, for searches that probe a few of them.

Cosine similarity. The centroids are fitted on a bounded sample (``sample_rows``); every vector is filed, in the list of its
nearest centroid, with the columns that filters need. A question probes the lists whose centroids are nearest. Each list
knows its radius, so that the best similarity which it can hold is known too: lists below a threshold are never read, and
an exact search goes on, after the first probes, with just those lists that may still hold one of the k best.

Scale: the number of lists, and with it what is sent to all tasks, has a bound in bytes (``centroid_mb``). Searches read only the
partitions of lists that are probed; a list with any share of all vectors, and one that many questions probe, are cut into
blocks; each pair of blocks is one task's work, which leaves k rows a question.

Cases: null vectors and those with null or non-finite entries are not indexed, nor are vectors of another length than the
first centroid's; zero vectors have a list of their own, are always probed and score 0; questions without a vector or of
another length get no rows; an empty table has an empty index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .search import _best_of_block, _top, metadata_filter

#: The list of vectors without a direction.
ZERO = -1
#: Bytes of what is made of some rows of a batch at once: their angles to all centroids, or their vectors for all lists.
PIECE_BYTES = 16 << 20
#: Scores are rounded to six places, so what may come within this of a threshold is looked at.
SLACK = 2e-6


@dataclass
class VectorIndex:
    path: str
    key: str
    centroids: np.ndarray = field(repr=False)
    radius: np.ndarray = field(repr=False)
    sizes: dict[int, int] = field(repr=False)
    schema: StructType = field(repr=False)

    def rows(self, spark: SparkSession, lists: list[int] | None = None) -> DataFrame:
        """The vectors, or those of some lists: only these partitions are read."""
        held = spark.read.schema(self.schema).parquet(f"{self.path}/vectors")
        return held if lists is None else held.filter(F.col("list").isin(lists))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def _pieces(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows that what is made of them has PIECE_BYTES at most (or is one row's)."""
    rows = max(1, PIECE_BYTES // row_bytes)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column.to_pylist()]) if len(column) else np.zeros((0, 1))


def build(
    vectors: DataFrame,
    path: str,
    key: str = "chunk_id",
    vector: str = "embedding",
    keep: tuple[str, ...] = (),
    lists: int | None = None,
    sample_rows: int = 200_000,
    centroid_mb: int = 64,
    list_files: int = 8,
    seed: int = 1,
) -> VectorIndex:
    """File all vectors under path. lists: by default the root of their number, within centroid_mb."""
    spark = vectors.sparkSession
    held = vectors.select(F.col(key), *keep, F.col(vector).cast("array<double>").alias("vector")).filter(_usable(F.col("vector")))
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    seen = held.filter(size > 0).groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dims, n = (seen["d"], seen["n"]) if seen else (1, 0)
    held = held.filter(F.size("vector") == dims)
    wanted = max(1, min(lists or round(n**0.5), (centroid_mb << 20) // (8 * dims), n or 1))
    if n:
        share = -(-n // sample_rows)
        sample = held.filter(size > 0).filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(array_to_vector("vector").alias("features"))
        model = KMeans(k=wanted, distanceMeasure="cosine", maxIter=10, seed=seed).fit(sample)
        centroids = _unit(np.array(model.clusterCenters(), float).reshape(-1, dims))
    else:
        centroids = np.zeros((1, dims))
    shared = spark.sparkContext.broadcast(centroids)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 8 * len(shared.value)):
            x = _matrix(batch.column(batch.num_columns - 1))
            far = _angles(_unit(x), shared.value)
            nearest = far.argmin(axis=1)
            none = ~x.any(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(none, ZERO, nearest), pa.int32()), pa.array(np.where(none, 0.0, far[np.arange(len(x)), nearest]))], names=[*batch.schema.names, "list", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    filed = held.mapInArrow(file, f"{kinds}, list int, angle double")
    filed.repartition("list", F.pmod(F.xxhash64(key), F.lit(list_files))).write.partitionBy("list").parquet(f"{path}/vectors")
    return _opened(spark, path, key, centroids, filed.schema)


def _opened(spark: SparkSession, path: str, key: str, centroids: np.ndarray, schema) -> VectorIndex:
    """The index, with a table of its lists beside the vectors."""
    told = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # a row a list
    radius, sizes = np.zeros(len(centroids)), {r["list"]: r["n"] for r in told}
    for r in told:
        if r["list"] >= 0:
            radius[r["list"]] = r["radius"]
    rows = [(i, c.tolist(), float(radius[i]), sizes.get(i, 0), None) for i, c in enumerate(centroids)] + [(ZERO, None, 0.0, sizes.get(ZERO, 0), schema.json())]
    spark.createDataFrame(rows, "list int, centroid array<double>, radius double, n long, schema string").coalesce(1).write.parquet(f"{path}/lists")
    return VectorIndex(path, key, centroids, radius, sizes, schema)


def opened(spark: SparkSession, path: str, key: str = "chunk_id") -> VectorIndex:
    """An index that was built before."""
    rows = sorted(spark.read.parquet(f"{path}/lists").collect(), key=lambda r: r["list"])
    own = [r for r in rows if r["list"] >= 0]
    schema = StructType.fromJson(json.loads(rows[0]["schema"]))
    return VectorIndex(path, key, np.array([r["centroid"] for r in own]), np.array([r["radius"] for r in own]), {r["list"]: r["n"] for r in rows if r["n"]}, schema)


def _routed(asked: DataFrame, index: VectorIndex, probes: int, least: float | None, later: bool) -> DataFrame:
    """query_id, qv, list for the lists to probe: the nearest `probes`, or (later, with the k-th score so far in `kth`) all
    others that may hold a better one; in either case none that holds nothing from `least` on."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centroids, index.radius, np.array([index.sizes.get(i, 0) for i in range(len(index.centroids))])))
    zero = bool(index.sizes.get(ZERO)) and (least is None or least <= SLACK)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radius, sizes = shared.value
        for batch in _pieces(batches, 8 * (centroids.size + len(centroids))):  # a question may take all lists, with its vector
            q = _matrix(batch.column(1))
            far = _angles(_unit(q), centroids)
            best = np.cos(np.clip(far - radius, 0.0, None)) + SLACK
            best[~q.any(axis=1)] = SLACK  # all scores of a question without direction are 0
            open_ = (sizes > 0)[None, :] & (best >= (-2.0 if least is None else least))
            order = np.argsort(np.where(open_, far, np.inf), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(q), axis=0), axis=1)
            if later:
                kth = batch.column(2).to_numpy(zero_copy_only=False)
                take = open_ & (rank >= probes) & (best >= kth[:, None])
            else:
                take = open_ & (rank < probes)
            at, lists = np.nonzero(take)
            if zero and not later:
                at, lists = np.r_[at, np.arange(len(q))], np.r_[lists, np.full(len(q), ZERO)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(lists, pa.int32())], names=["query_id", "qv", "list"])

    dims = index.centroids.shape[1]
    held = asked.filter(_usable(F.col("qv")) & (F.size("qv") == dims))
    return held.select("query_id", "qv", *(["kth"] if later else [])).mapInArrow(route, "query_id long, qv array<double>, list int")


def _probed(index: VectorIndex, routes: DataFrame, k: int, least: float | None, others: bool, filters: dict | None, block_rows: int, block_questions: int) -> DataFrame:
    """query_id, key, score: of each pair of a block of a list and a block of its questions, k rows a question."""
    spark, key = routes.sparkSession, index.key
    told = {r["list"]: r["n"] for r in routes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    blocks = [(i, max(1, -(-index.sizes.get(i, 0) // block_rows)), max(1, -(-n // block_questions))) for i, n in told.items()]
    plan = F.broadcast(spark.createDataFrame(blocks, "list int, _of_rows int, _of_asked int"))  # a row a list
    rows = metadata_filter(index.rows(spark, sorted(told)), filters or {})
    place = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows = rows.select(F.col(key).alias("_key"), F.col("vector").alias("_v"), "list").join(plan, "list").select("_key", "_v", "list", own("_key", "_of_rows").alias("_a"), place("_of_asked").alias("_b"))
    held = routes.join(plan, "list").select("query_id", "qv", "list", place("_of_rows").alias("_a"), own("query_id", "_of_asked").alias("_b"))
    kind = index.rows(spark).schema[key].dataType.simpleString()
    pairs = rows.groupBy("list", "_a", "_b").cogroup(held.groupBy("list", "_a", "_b"))

    def best(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(r, q, k, least, others, key)

    return pairs.applyInPandas(best, f"query_id long, `{key}` {kind}, score double")


def search(
    index: VectorIndex,
    asked: DataFrame,
    k: int = 20,
    probes: int = 8,
    exact: bool = False,
    least: float | None = None,
    others: bool = False,
    filters: dict | None = None,
    block_rows: int = 50_000,
    block_questions: int = 4_096,
) -> DataFrame:
    """query_id, key, score, rank of the k best for asked (query_id, qv): those of the lists probed, or of all (exact).

    filters: equalities on the columns that the index keeps, applied before the k best are chosen; an exact search fills up from
    further lists what the filters left out of the first ones. least: the lowest score; others: a question's own key is no answer.
    """
    held = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv"))
    how = (k, least, others, filters, block_rows, block_questions)
    found = _probed(index, _routed(held, index, probes, least, later=False), *how)
    if exact:
        first = _top(found, k, F.desc("score"), F.col(index.key))
        kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        left = held.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
        found = first.drop("rank").unionByName(_probed(index, _routed(left, index, probes, least, later=True), *how))
    return _top(found, k, F.desc("score"), F.col(index.key))
