"""Embedding whitening: components of the covariance by QDWH spectral divide and conquer, applied to all vectors.

Two passes gather the exact sums and the covariance, centred before multiplying, as partial matrices that Spark adds up by
row; what reaches the driver is one matrix of dimensions by dimensions, whatever the number of vectors. There the
polar factor of the shifted covariance (QR-based dynamically weighted Halley steps) gives a spectral projector, which splits the
space into two invariant subspaces; these are split again until each is one component. The matrix of components is sent
along with the tasks, and the vectors are projected where they are.

Cases: vectors that are null or hold null or non-finite entries are left out, and so are empty vectors and those of another
length than most (the shorter length, if two are as frequent); entries beyond 2^52 count as 2^52; repeated rows and null ids count
like any other; components without variance are left out, so one vector, or equal ones, give no rows; equal eigenvalues
may have any basis of their space; a deviation that a long cannot hold is null; an empty table gives an empty table;
further columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**52
#: A component whose share of the largest eigenvalue is less is rounding.
LEAST = 1e-13


def polar(a: np.ndarray, least: float = 1e-16) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, for which it is the matrix sign. Six or seven steps do for singular
    values from `least` of the largest on."""
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low, eye = least, np.eye(len(a))
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) / 2 if low < 1 else 3.0
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        q1 = np.linalg.qr(np.concatenate([np.sqrt(r) * x, eye]))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * q1[: len(a)] @ q1[len(a) :].T
        low = min(1.0, low * (p + q * low * low) / (1 + r * low * low))
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        if moved < 1e-14 * len(a):
            break
    return x


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are one to rounding."""
    n, middle = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * np.finfo(float).eps * scale:
        return None
    best = None
    for k in range(24):  # shifts about the mean, which lies between the eigenvalues; one of them may hit an eigenvalue
        shift = middle + spread * 0.61 * ((k + 1) // 2) / 12 * (-1) ** k
        sign = polar(a - shift * np.eye(n))
        above = (sign + np.eye(n)) / 2
        rank = round(float(np.trace(above)))
        if not 0 < rank < n:
            continue
        basis = np.linalg.qr(above @ rng.standard_normal((n, rank)))[0]
        basis = np.linalg.qr(above @ basis)[0]
        both = np.linalg.qr(basis, mode="complete")[0]
        left = np.linalg.norm(both[:, rank:].T @ a @ both[:, :rank])
        if best is None or left < best[0]:
            best = left, both[:, :rank], both[:, rank:]
        if left <= 8 * n * np.finfo(float).eps * scale:
            break
    return best and best[1:]


def components(a: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns; the largest entry of each is positive."""
    rng, scale = np.random.default_rng(seed), np.linalg.norm(a)
    todo, done = [np.eye(len(a))], []
    while todo:
        basis = todo.pop()
        if basis.shape[1] == 1:
            done.append(basis)
            continue
        own = basis.T @ a @ basis
        parts = _split((own + own.T) / 2, scale, rng)
        if parts is None:
            done.append(basis)
        else:
            todo += [np.linalg.qr(basis @ part)[0] for part in parts]
    vectors = np.concatenate(done, axis=1)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return values[order], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


def _fit(vector: Column) -> Column:
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ok


def scaled(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x (whole numbers) of the vectors that take part."""
    held = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).filter(_fit(F.col("v")))
    most = held.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    length = most.first()
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), SCALE * c))) + OFFSET)
    return held.filter(F.size("v") == (length["d"] if length else 0)).select(key, whole.alias("x"))


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    c = batch.column(column)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _summed(df: DataFrame, column: str, of) -> np.ndarray:
    """The sum over all rows of a matrix that of(rows) makes of some of them: partial matrices, added up row by row in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            if batch.num_rows:
                own = of(_rows(batch, 0))
                made = own if made is None else made + own
        if made is not None:
            at = np.indices(made.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(made.ravel())], names=["i", "j", "v"])

    parts = df.select(column).mapInArrow(run, "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((int(found["i"].max()) + 1, int(found["j"].max()) + 1))
    out[found["i"], found["j"]] = found["v"]
    return out


def covariance(df: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    def of(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return y.T @ y

    out = _summed(df, column, of) / n
    return (out + out.T) / 2


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame | None:
    """key, n, deviation, component, whitened, explained, identity_error; None if no vector takes part."""
    spark = vectors.sparkSession
    held = materialise(scaled(vectors, key, vector))
    sums = held.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not sums:
        return None
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    mean = np.array([s / n for s in total])  # of whole numbers, so rounded once
    v = covariance(held, "x", mean, n)
    e, axes = components(v)
    some = min(most, int((e > LEAST * max(e[0], 0)).sum())) if e[0] > 0 else 0
    trace, project = float(np.trace(v)), axes[:, :some] / np.sqrt(e[:some])
    shared = spark.sparkContext.broadcast((mean, project, n, total))  # dimensions by components, whatever the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, project, n, total = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch, 1)
            w = (x - mean) @ project
            # Exact: in 64 bits where these hold the sum of squares, else in whole numbers of any size.
            large = float(np.abs(x - mean).max() + 1) * n
            if large * large * x.shape[1] < 2**62:
                far = ((n * x - np.array(total)) ** 2).sum(axis=1).tolist()
            else:
                far = [sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x.tolist()]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f if f < 2**63 else None for f in far], pa.int64()), rows], names=["key", "deviation", "w"])

    kind = vectors.schema[key].dataType.simpleString()
    out = materialise(held.select(F.col(key).alias("key"), "x").mapInArrow(run, f"key {kind}, deviation long, w array<double>"))
    error = 0.0
    if some:
        centre = _summed(out, "w", lambda w: w.sum(axis=0)[None, :])[0] / n
        error = float(np.abs(covariance(out, "w", centre, n) - np.eye(some)).max())
    share = F.array(*[F.lit(float(x / trace)) for x in e[:some]]).cast("array<double>")
    told = out.select(F.col("key").alias(key), "deviation", F.posexplode("w").alias("i", "whitened"))
    return told.select(key, (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out if out is not None else spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
