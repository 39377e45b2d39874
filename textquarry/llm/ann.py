"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

A shard holds as many vectors as ``shard_mb`` of memory allows, dealt by a hash of id and vector; it is smaller only where
that keeps all cores busy. Nodes enter the graph in a hashed order, those with a higher level first, some at a time: a
beam search from the level above finds each one's nearest among the nodes before it, those that enter with it are compared
directly, and it is linked to a spread choice of both and back; crowded nodes shed links. The index is a table with a row
for each node: its neighbours by level as one flat array. Searching streams each shard's nodes and then its queries
through one task, so memory holds one shard and one batch of queries; a beam search runs over many queries at once with
numpy. Equal vectors of a shard are one node with their smallest ids, of which any result can use k + 1 at most.

Graphs work on vectors scaled by a power of two, so that no square overflows; distances in results are those of the
vectors themselves, in double precision.

Cases: rows whose vector is null, empty, zero or holds null or non-finite components, or whose id is null, take no part;
vectors of another length never meet; of repeated ids a query takes the smallest vector, a candidate its nearest; rows
alike in id and vector are one; ties go to the smaller id; with fewer than k candidates all are returned; an empty table
gives an empty table; further columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, table


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _exponent(x: np.ndarray) -> int:
    """The power of two that x's largest component is below."""
    return int(np.frexp(np.abs(x).max(initial=0.0))[1])


def for_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x as its graph sees it, and the power of two it is scaled by: single precision where no square can vanish in it."""
    size = np.abs(x).max(axis=1, initial=0.0)
    near = size[size > 0].min(initial=np.inf) * 1e12 > size.max(initial=0.0)
    shift = -_exponent(x) if near else 400 - _exponent(x)
    return np.ldexp(x, shift).astype(np.float32 if near else np.float64), shift


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances from v, in double precision; scaling by a power of two changes no bit and avoids overflow."""
    shift = -max(_exponent(x), _exponent(v))
    d = np.ldexp(x, shift) - np.ldexp(v, shift)
    return np.ldexp(np.sqrt((d * d).sum(axis=1)), -shift)


def _spread(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) those nearer to the row's node than to any chosen before; what is
    left of `most` is filled with the nearest others, and padded with -1."""
    n, width = cand.shape
    own = x[cand]
    norm = (own * own).sum(axis=2)
    gap = norm[:, :, None] + norm[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    valid = cand >= 0
    covered, chosen, count = ~valid, np.zeros((n, width), bool), np.zeros(n, np.int64)
    for c in range(width):
        take = ~covered[:, c] & (count < most)
        chosen[:, c] = take
        count += take
        covered |= take[:, None] & (gap[:, c, :] <= dist)
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, order, axis=1)


def _squares(x: np.ndarray, near: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x[near]
    d -= q[:, None, :]
    return np.einsum("bnd,bnd->bn", d, d)


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes that a best-first walk from start (one node for each query) finds, nearest first (-1: none), and their squared distances."""
    ids = np.full((len(q), ef), -1, np.int64)
    dist = np.full((len(q), ef), np.inf, x.dtype)
    ids[:, 0] = start
    dist[:, 0] = _squares(x, ids[:, :1], q)[:, 0]
    done = ids < 0
    while True:
        rows = np.flatnonzero(~done.all(axis=1))
        if not len(rows):
            return ids, dist
        best = np.where(done[rows], np.inf, dist[rows]).argmin(axis=1)
        done[rows, best] = True
        near = links[ids[rows, best]]
        d = _squares(x, near, q[rows])
        d[(near < 0) | (near[:, :, None] == ids[rows][:, None, :]).any(axis=2)] = np.inf
        all_ids, all_d = np.concatenate([ids[rows], near], axis=1), np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], np.isinf(d)], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(v, keep, axis=1) for v in (all_ids, all_d, all_done))
        gone = np.isinf(dist[rows])
        ids[rows] = np.where(gone, -1, ids[rows])
        done[rows] |= gone


def _enter(x: np.ndarray, links: np.ndarray, first: int, size: int, start: np.ndarray, m: int, ef: int) -> None:
    """Link nodes first to first + size, which have none yet, to the nodes before them and back."""
    new = np.arange(first, first + size)
    q, most = x[new], links.shape[1]
    wide = q.astype(np.float64)
    norm = (wide * wide).sum(axis=1)
    gap = np.maximum(norm[:, None] + norm[None, :] - 2 * wide @ wide.T, 0)
    gap[np.triu_indices(size)] = np.inf
    w = min(ef, size)
    near = np.argpartition(gap, w - 1, axis=1)[:, :w]
    dist = np.take_along_axis(gap, near, axis=1)
    cand = np.where(np.isinf(dist), -1, near + first)
    if first:
        ids, d = _beam(x, links, q, start, ef)
        cand, dist = np.concatenate([ids, cand], axis=1), np.concatenate([d, dist], axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, : max(ef, m)]
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    own = _spread(x, cand, dist, m)
    links[new, : own.shape[1]] = own
    a, c = np.nonzero(own >= 0)
    src, dst = new[a], own[a, c]
    d = ((x[src] - x[dst]) ** 2).sum(axis=1)
    order = np.lexsort((src, d, dst))
    src, dst, d = src[order], dst[order], d[order]
    heads, at = np.unique(dst, return_inverse=True)
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    more = min(int(place.max(initial=-1)) + 1, most)
    held = place < more
    cand, dist = np.full((len(heads), more), -1, np.int64), np.full((len(heads), more), np.inf, x.dtype)
    cand[at[held], place[held]], dist[at[held], place[held]] = src[held], d[held]
    before = links[heads]
    far = _squares(x, before, x[heads])
    far[before < 0] = np.inf
    cand, dist = np.concatenate([before, cand], axis=1), np.concatenate([far, dist], axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    out = cand[:, :most].copy()
    crowded = np.flatnonzero((cand >= 0).sum(axis=1) > most)
    for i in range(0, len(crowded), 1024):
        some = crowded[i : i + 1024]
        out[some] = _spread(x, cand[some], dist[some], most)
    links[heads] = -1
    links[heads, : out.shape[1]] = out


def _levels(ids: np.ndarray, m: int, top: int = 6) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(top, (-np.log(u) / np.log(m)).astype(np.int64))


def _descend(x: np.ndarray, links: list[np.ndarray | None], q: np.ndarray, to: int, ef: int = 8) -> np.ndarray:
    """The nearest node that is found in the levels above `to`, for each query."""
    at = np.zeros(len(q), np.int64)
    for level in range(len(links) - 1, to, -1):
        at = _beam(x, links[level], q, at, ef)[0][:, 0]
    return at


def build(ids: np.ndarray, x: np.ndarray, k: int, m: int, ef: int = 64, batch: int = 1024) -> pd.DataFrame:
    """The nodes of one shard, in the order in which they enter: node, ids, vector, level and neighbours by level, flat."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
    ends = np.r_[first[1:], len(x)]
    groups = [np.unique(ids[a : min(b, a + 4 * k + 4)])[: k + 1] if b - a > 1 else ids[a:b] for a, b in zip(first, ends, strict=True)]
    x = x[first]
    low = np.array([g[0] for g in groups])
    level = _levels(low, m)
    order = np.lexsort((low, _levels(low + 1, 2, 60), -level))  # a higher level first, else by hash
    x, level, groups = x[order], level[order], [groups[i] for i in order]
    g, _ = for_graph(x)
    size = [int((level >= at).sum()) for at in range(int(level.max()) + 1)]
    links: list[np.ndarray | None] = [None] * len(size)
    for at in range(len(size) - 1, -1, -1):
        links[at] = np.full((size[at], 2 * m if at == 0 else m), -1, np.int64)
        done, above = 0, size[at + 1] if at + 1 < len(size) else 0
        while done < size[at]:
            n = min(size[at] - done, max(64, min(batch, done)))
            if done < above:
                n = min(n, above - done)
            # Nodes of the level above enter from node 0, as some they would be led to are not here yet.
            start = _descend(g, links, g[done : done + n], at) if done >= above else np.zeros(n, np.int64)
            _enter(g, links[at], done, n, start, m, ef)
            done += n
    flat = [np.concatenate([np.pad(links[at][i], (0, 2 * m - links[at].shape[1]), constant_values=-1) for at in range(level[i] + 1)]) for i in range(len(x))]
    return pd.DataFrame({"node": np.arange(len(x)), "ids": [list(map(int, v)) for v in groups], "vector": list(x), "level": level, "neighbours": flat})


class Shard:
    """One shard's graph, read back from its rows."""

    def __init__(self, nodes: pd.DataFrame, m: int):
        nodes = nodes.sort_values("node")
        self.x = np.stack(nodes["vector"].to_numpy()).astype(np.float64)
        self.g, self.shift = for_graph(self.x)
        self.ids = nodes["ids"].tolist()
        level = nodes["level"].to_numpy()
        self.links = []
        for at in range(int(level.max()) + 1):
            n = int((level >= at).sum())
            self.links.append(np.array([f[2 * m * at : 2 * m * (at + 1)] for f in nodes["neighbours"].iloc[:n]], np.int64))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, ef: int) -> list[tuple[int, int, float]]:
        out = []
        for s in range(0, len(q), 256):
            own = q[s : s + 256].astype(np.float64)
            with np.errstate(over="ignore"):
                scaled = np.ldexp(own, self.shift).astype(self.g.dtype)
                fit = (np.abs(scaled) < (1e15 if self.g.dtype == np.float32 else 2.0**450)).all(axis=1)
            found = np.full((len(own), ef), -1, np.int64)
            if fit.any():
                found[fit] = _beam(self.g, self.links[0], scaled[fit], _descend(self.g, self.links, scaled[fit], 0), ef)[0]
            for i, v, nodes, near in zip(ids[s : s + 256].tolist(), own, found, fit, strict=True):
                nodes = nodes[nodes >= 0] if near else np.arange(len(self.x))  # far beyond the shard's range: all of it
                exact = distances(self.x[nodes], v)
                if not near:
                    least = np.argsort(exact, kind="stable")[: ef + k]
                    nodes, exact = nodes[least], exact[least]
                best = sorted((d, j) for d, n in zip(exact.tolist(), nodes.tolist(), strict=True) for j in self.ids[n] if j != i)
                out += [(i, j, d) for d, j in best[:k]]
        return out


def _sized(rows: DataFrame, shard_mb: int, cores: int) -> DataFrame:
    """dim, shards: a row for each length of vectors."""
    n = F.count(F.lit(1))
    by_memory = F.ceil(n * (12 * F.col("dim") + 160) / F.lit(shard_mb * 1_000_000))
    return rows.groupBy("dim").agg(F.greatest(by_memory, F.least(F.lit(cores), F.ceil(n / 8192))).cast("int").alias("shards"))


def build_index(vectors: DataFrame, shard_mb: int = 96, key: str = "vec_id", vector: str = "embedding", k: int = 10, m: int = 16, cores: int | None = None) -> DataFrame:
    """The index table: dim, shard, shards (of that dim), node, ids, vector, level, neighbours."""
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.size(vector).alias("dim"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    rows = materialise(rows)
    sizes = _sized(rows, shard_mb, cores or vectors.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        out = build(group["id"].to_numpy(), np.stack(group["v"].to_numpy()), k, m)
        out = out.assign(**{c: group[c].iloc[0] for c in ("dim", "shard", "shards")})
        return out[["dim", "shard", "shards", "node", "ids", "vector", "level", "neighbours"]]

    schema = "dim int, shard int, shards int, node int, ids array<long>, vector array<double>, level int, neighbours array<int>"
    index = materialise(dealt.groupBy("dim", "shard").applyInPandas(make, schema))
    forget(rows)
    return index


def search_index(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, m: int = 16, ef: int = 160) -> DataFrame:
    """query_id, rank, vec_id, score for each usable query: the k nearest over all shards, other than the query's own id."""
    held = queries.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    one = held.groupBy(F.col(key).cast("long").alias("node")).agg(F.min(F.col(vector).cast("array<double>")).alias("vector"))
    shards = index.select("dim", "shards").distinct()  # a row for each length
    asked = one.withColumn("dim", F.size("vector")).join(F.broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "node", "vector")
    both = index.drop("shards").withColumn("node", F.col("node").cast("long")).withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, shard = None, [], None
        for batch in batches:
            for place, part in batch.groupby(["dim", "shard", "asks"], sort=True):
                if place[:2] != at:
                    at, held, shard = place[:2], [], None
                if place[2] == 0:
                    held.append(part)
                elif held:
                    shard = shard or Shard(pd.concat(held), m)
                    found = shard.search(part["node"].to_numpy(), np.stack(part["vector"].to_numpy()), k, ef)
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = dealt.mapInPandas(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search_index(build_index(vectors), vectors.filter(F.col("vec_id") % 100 == 0))
