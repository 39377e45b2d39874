"""Indexes of vectors and of texts: recall, exactness against searches of all rows, what the plan reads, hot keys."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry import storage
from textquarry.operators import catalog, search, text_index, vector_index
from textquarry.storage import join_hot, new_folder

VECTORS = "chunk_id long, embedding array<double>, label int"


def clustered(n, dims, seed=1, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    x = centres[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, dims))
    return [(i, v.tolist(), i % 5) for i, v in enumerate(x)]


def same(got, want):
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    return key(got) == key(want)


@pytest.mark.parametrize("dims", [16, 64, 256, 768])
def test_recall_and_exact_search(spark, dims):
    rows = clustered(3000, dims)
    df = spark.createDataFrame(rows, VECTORS)
    index = vector_index.build(df, new_folder(spark), keep=("label",))
    assert sum(index.sizes.values()) == 3000 and len(index.centroids) == 55
    asked = df.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv"))
    want = search.dense_search(df, asked, 10)
    near = {(r["query_id"], r["chunk_id"]) for r in want.collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in vector_index.search(index, asked, 10, probes=8).collect()}
    assert len(found & near) >= 0.95 * len(near)
    assert same(vector_index.search(index, asked, 10, probes=1, exact=True), want)


def test_filters_thresholds_and_blocks(spark):
    df = spark.createDataFrame(clustered(1500, 8), VECTORS)
    index = vector_index.opened(spark, vector_index.build(df, new_folder(spark), keep=("label",), lists=30).path)
    asked = df.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv"))
    some = df.filter("label IN (1, 2)")
    assert same(vector_index.search(index, asked, 10, probes=2, exact=True, filters={"label": [1, 2]}), search.dense_search(some, asked, 10))
    assert same(vector_index.search(index, asked, 500, probes=2, exact=True, least=0.7), search.dense_search(df, asked, 500, least=0.7))
    blocks = {"block_rows": 7, "block_questions": 2}
    assert same(vector_index.search(index, asked, 10, exact=True, others=True, **blocks), search.dense_search(df, asked, 10, others=True))


def test_only_probed_partitions_are_read(spark):
    df = spark.createDataFrame(clustered(600, 8), VECTORS)
    index = vector_index.build(df, new_folder(spark), lists=20)
    plan = index.rows(spark, [3, 5])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "IN (3,5)" in plan.replace("list#", "list ").replace(" ", "").replace("IN(", "IN (")
    assert {r[0] for r in index.rows(spark, [3, 5]).select("list").distinct().collect()} <= {3, 5}
    near = vector_index._routed(df.limit(1).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv")), index, 4, None, later=False)
    assert near.count() == 4
    far = vector_index._routed(df.limit(1).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv")), index, 20, 0.9999, later=False)
    assert far.count() < 20  # lists that hold nothing so near are left out


def test_vectors_without_use_and_equal_ones(spark):
    odd = [(1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [1.0], 0), (5, [0.0, 0.0], 0), *[(10 + i, [1.0, 1.0], 0) for i in range(40)], (90, [1.0, -1.0], 0), (91, [-1.0, -1.0], 0)]
    df = spark.createDataFrame(odd, VECTORS)
    index = vector_index.build(df, new_folder(spark), lists=3)
    asked = spark.createDataFrame([(1, [2.0, 2.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "query_id long, qv array<double>")
    got = vector_index.search(index, asked, 43, probes=1, exact=True)
    whole = df.filter("chunk_id IN (5, 90, 91) OR chunk_id BETWEEN 10 AND 50")
    assert same(got, search.dense_search(whole, asked.filter("query_id IN (1, 4)"), 43))
    empty = vector_index.build(df.limit(0), new_folder(spark))
    assert vector_index.search(empty, asked, 5).count() == 0 and vector_index.search(empty, asked, 5, exact=True).count() == 0


def texts(n, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_text_index_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(text_index, "PER_RANGE", 16)
    rows = [*texts(900), (1000, None), (1001, ""), (1002, "only here é"), (1003, "Only HERE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = search.questions(spark, [(1, None, ["w1", "w2"]), (2, None, ["w1", "w7", "w30"]), (3, None, ["only", "here"]), (4, None, ["none"]), (5, None, ["w1", "none"]), (6, None, []), (7, None, None), (8, None, ["w1"]), (9, None, ["w1"])])
    index = text_index.opened(spark, text_index.build(df, new_folder(spark)).path)
    words = {i: (t or "").lower().split() for i, t in rows}
    want = {}
    for q, ts in [(1, "w1 w2"), (2, "w1 w7 w30"), (3, "only here"), (8, "w1"), (9, "w1")]:
        want[q] = sorted(i for i, w in words.items() if set(ts.split()) <= set(w))[:20]
    for got in (text_index.keyword_search(index, asked), search.keyword_search(df, asked, key="doc_id")):
        held = {}
        for r in got.orderBy("query_id", "rank").collect():
            held.setdefault(r["query_id"], []).append(r["doc_id"])
        assert held == {q: v for q, v in want.items() if v}
    rank = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert rank(text_index.bm25_search(index, asked, k=5)) == rank(search.bm25(df, asked, k=5))


def test_bm25_skips_blocks(spark, monkeypatch):
    """A rare term gives the threshold; ranges that hold only a frequent one are not opened."""
    monkeypatch.setattr(text_index, "PER_RANGE", 4)
    rows = [(i, "the " * 3 + "cat " * (i % 97 == 0) * 3 + f"x{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = text_index.build(df, new_folder(spark))
    asked = search.questions(spark, [(1, None, ["the", "cat"])])
    opened = []
    real = text_index.written

    def told(df):
        out = real(df)
        if out.columns == ["query_id", "range", "term", "idf"]:
            opened.append(out.select("range").distinct().count())
        return out

    monkeypatch.setattr(text_index, "written", told)
    got = text_index.bm25_search(index, asked, k=3).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 97, 194]
    assert sum(opened) < 60 < text_index.ranges_for(2000)


def test_hot_keys_meet_once(spark):
    big = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(500)] + [(None, 1)], "key string, x int")
    small = spark.createDataFrame([("hot", "a"), ("k3", "b"), ("other", "c")], "key string, y string")
    got = join_hot(big, small, ["key"])
    assert got.count() == 3001 and got.select("x", "y").distinct().count() == 3001
    assert join_hot(big, small, ["key"], "left").count() == 3501 and join_hot(big.limit(0), small, ["key"]).count() == 0
    cache = spark.createDataFrame([("t",)], "text string").select(F.md5("text").alias("key"), F.array(F.lit(1.0)).alias("v"))
    hits, lacking = catalog.cache_split(spark.createDataFrame([("t",)] * 2000 + [("u",)] * 5, "text string"), cache)
    assert hits.count() == 2000 and [r["text"] for r in lacking.collect()] == ["u"]


def test_nfc_goes_to_python_only_for_marks(spark):
    from textquarry.functions import text as T

    rows = [("éa",), ("plain",), ("déjà",), ("Å",), ("",), (None,), ("à́",)]
    import unicodedata

    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.nfc("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for (t,) in rows]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_the_index_shuffles_texts_once(spark):
    """neither terms nor postings are shuffled; the blocks equal those counted here, whatever the keys' type."""
    rows = [*[(f"k{i}", t) for i, t in texts(300)], ("z", None), ("y", ""), ("x", "É é the THE"), (None, "w1 w1")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = text_index.postings(df.coalesce(1), "doc_id", "text", 7)
    assert exchanges(got) == 2  # the repartition above, and the one by range
    want = {}
    for k, t in rows:
        words = (t or "").lower().split()
        for w in set(words):
            want.setdefault(w, []).append((k or "", words.count(w), len(words)))
    held = {}
    for r in got.collect():
        own = [(x["key"] or "", x["tf"], x["dl"]) for x in r["docs"]]
        assert (r["n"], r["max_tf"], r["min_dl"], r["words"]) == (len(own), max(x[1] for x in own), min(x[2] for x in own), sum(x[1] for x in own))
        held.setdefault(r["term"], []).extend(own)
    assert {w: sorted(v) for w, v in held.items()} == {w: sorted(v) for w, v in want.items()}
    assert text_index.postings(df.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_questions_look_at_their_rarest_term_only(spark, monkeypatch, few):
    """F11 and others: pairs of questions and documents are made for a question's rarest term, not for each of its terms."""
    monkeypatch.setattr(storage, "FEW_ROWS", few)
    df = spark.createDataFrame([(i, f"the and r{i % 50} u{i}") for i in range(400)], "doc_id long, text string")
    asked = search.questions(spark, [(q, None, ["the", "and", f"r{q}"]) for q in range(40)] + [(90, None, ["the"]), (91, None, ["the", "none"])])
    met = []
    real = search.join_few

    def told(big, small, on, by, how="inner"):
        out = real(big, small, on, by, how)
        if "query_id" in out.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(search, "join_few", told)
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search.keyword_search(df, asked, 5, "doc_id").collect())
    assert got == sorted([(q, n + 1, q + 50 * n) for q in range(40) for n in range(5)] + [(90, n + 1, n) for n in range(5)])
    assert met == [40 * 8 + 400]


def test_questions_are_worked_out_once(spark, tmp_path):
    from textquarry.plans import registry

    docs = spark.createDataFrame([(i, f"some text{i}") for i in range(201)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(201)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = registry._asked(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in asked.inputFiles())
    assert sorted((r["query_id"], r["ts"]) for r in asked.collect()) == [(q, [f"text{q}", "some"]) for q in (0, 100, 200)]


def test_routes_are_made_in_pieces(spark, monkeypatch):
    """what one batch of questions becomes is bounded, though each of them may take all lists."""
    rng = np.random.default_rng(3)
    n, dims, lists = 500, 4, 10
    index = vector_index.VectorIndex("", "chunk_id", vector_index._unit(rng.standard_normal((lists, dims))), np.full(lists, 3.0), dict.fromkeys(range(lists), 5), None)
    asked = spark.createDataFrame([(i, rng.standard_normal(dims).tolist()) for i in range(n)], "query_id long, qv array<double>").coalesce(1)
    monkeypatch.setattr(vector_index, "PIECE_BYTES", 20 * 8 * (lists * dims + lists))
    routes = vector_index._routed(asked, index, lists, None, later=False)
    batches = routes.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sum(r["n"] for r in batches.collect()) == n * lists
    pieces = list(vector_index._pieces(iter([pa.RecordBatch.from_pydict({"x": list(range(n))})]), 8 * (lists * dims + lists)))
    assert [p.num_rows for p in pieces] == [20] * 25 and pa.Table.from_batches(pieces)["x"].to_pylist() == list(range(n))
    assert [p.num_rows for p in vector_index._pieces(iter(pieces[:1]), 1 << 40)] == [1] * 20
