"""Whitening against numpy's own eigenvectors, and the cases of vectors that take no part."""

import math

import numpy as np
import pytest

from textquarry.llm import whitening


@pytest.mark.parametrize("kind", ["random", "equal", "hit", "steep", "two", "low rank", "one", "zero"])
def test_components(kind):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    a = {
        "random": np.cov(rng.standard_normal((24, 90))),
        "equal": np.eye(24),
        "hit": np.diag([1.0, 2.0, 3.0]),  # the first shift is an eigenvalue
        "steep": turn @ np.diag(10.0 ** -np.arange(24)) @ turn.T,
        "two": turn @ np.diag([1.0] * 12 + [2.0] * 12) @ turn.T,
        "low rank": np.cov(rng.standard_normal((24, 6))),
        "one": np.array([[4.0]]),
        "zero": np.zeros((3, 3)),
    }[kind]
    e, v = whitening.components(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale
    assert np.abs(a @ v - v * e).max() <= 1e-13 * scale and np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13
    assert (v[np.abs(v).argmax(axis=0), np.arange(len(a))] > 0).all()


def test_polar_is_the_matrix_sign():
    a = np.diag([5.0, 1e-9, -2.0, -1e-12])
    assert np.abs(whitening.polar(a) - np.diag([1.0, 1.0, -1.0, -1.0])).max() < 1e-10


def test_whitened(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 5)) @ np.diag([3.0, 2.0, 1.0, 0.5, 0.2])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(3, rows[3][1]), (None, rows[4][1])]  # a repeated row, a row without id
    out = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [math.nan] * 5), (904, [math.inf, 0.0, 0.0, 0.0, 0.0]), (905, [1.0] * 4)]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<double>").selectExpr("*", "'own' AS n", "'own' AS key", "'own' AS x", "1 AS component")
    got = whitening.whitened(df.repartition(5)).collect()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    cov = (x - s / n).T @ (x - s / n) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 5 * n and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9
    far = ((n * x - s) ** 2).sum(axis=1)
    for component in range(1, 6):
        own = [r for r in got if r["component"] == component]
        assert abs(own[0]["explained"] - e[component - 1] / e.sum()) < 1e-12
        want = (x - s / n) @ v[:, component - 1] / np.sqrt(e[component - 1])
        held = {i: (w, f) for (i, _), w, f in zip(rows, want.tolist(), far.tolist(), strict=True)}
        sign = np.sign(held[0][0]) * np.sign(next(r["whitened"] for r in own if r["vec_id"] == 0))
        assert all(abs(r["whitened"] - sign * held[r["vec_id"]][0]) < 1e-9 and r["deviation"] == held[r["vec_id"]][1] for r in own)


def test_whitened_without_variance_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)) is None
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(4)], schema))
    assert {r["component"] for r in flat.collect()} == {1}  # the other has no variance
    large = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert {r["deviation"] for r in large if r["vec_id"] < 3} == {None} and all(math.isfinite(r["whitened"]) for r in large)


def test_op11_on_the_given_table(spark):
    got = whitening.op11_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 32 and got["identity_error"].max() < 1e-9
    one = got[got["component"] == 7].set_index("vec_id")["whitened"]
    assert abs(one.mean()) < 1e-9 and abs((one**2).mean() - 1) < 1e-9
