"""The n-gram join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import jaccard

SCHEMA = "doc_id long, text string"


def sets(text, words):
    w = bytes((text or "").encode()).translate(jaccard._LOWER).split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, words, percent):
    """(id, size, smallest id) of each row, by the inverted lists of all n-grams."""
    own, up = [sets(t, words) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    lists, both = defaultdict(list), defaultdict(int)
    for i, s in enumerate(own):
        for g in s:
            for j in lists[g]:
                both[j, i] += 1
            lists[g].append(i)
    for (i, j), n in both.items():
        if 100 * n >= percent * (len(own[i]) + len(own[j]) - n):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[top(i)].append(k)
    least = {i: min((k for k in ks if k is not None), default=None) for i, ks in low.items()}
    return sorted(((k, len(own[i]), least[top(i)]) for i, (k, _) in enumerate(rows)), key=str)


def family(rng, words, n, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize(("words", "percent", "edits"), [(4, 85, 10), (5, 80, 9), (2, 50, 30)])
def test_families_near_the_threshold(spark, words, percent, edits):
    """Copies whose similarities lie on both sides of the threshold, so that few link with the least of a column."""
    rng = random.Random(words)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for k in (9, 30, 150, 151) for t in family(rng, k, 60, max(1, edits * k // 150))]
    texts += [f"{passage} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(40)) for _ in range(50)]  # a passage of many
    texts += [" ".join(f"short{i % 7}" for _ in range(i % 9)) for i in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(6), words=words, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, words, percent)


def test_cases(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "One"), (5, "one"), (4, "one two"), (None, "a b c d e"), (3, "A B C D E"), (None, "none has an id here"), (2, long), (1, long + " end"), *[(11, "the same row again and again")] * 4]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == brute(rows, 4, 85)
    clash = df.select("*", *[F.lit("own").alias(c) for c in ("node", "n", "key", "at", "column", "root", "salt", "a.b")])
    assert sorted(map(tuple, jaccard.jaccard_components(clash).collect()), key=str) == brute(rows, 4, 85)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_tiles_and_rounds(spark, monkeypatch):
    """Columns of several tiles, and rounds in which the closest pairs of two components are no links."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "BATCH", 1)
    monkeypatch.setattr(jaccard, "GROWTH", 3)
    rows = list(enumerate(family(random.Random(3), 150, 120, 12)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 85)


def test_no_linked_pair_is_discarded():
    """Every linked pair shares columns that both keep, and its parities never differ too much."""
    rng = random.Random(8)
    for percent in (85, 80, 60):
        deal = jaccard.Deal(percent)
        for _ in range(400):
            n = rng.randint(3, 120)
            x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            y = np.unique(np.r_[x[rng.randint(0, 3 + n // 12) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 3 + n // 12))], np.uint64)])
            if len(x) == len(y) and (x == y).all() or not len(y) or not jaccard.similar(x, y, percent):
                continue
            met = [(a, b) for a, c in ((deal.columns(x, c), c) for c in deal.classes(len(x))) for b, d in ((deal.columns(y, c), c) for c in deal.classes(len(y))) if c == d]
            shared = [(len(set(a[0]) & set(b[0])), a, b) for a, b in met]
            assert any(both >= max(a[1], b[1], 1) for both, a, b in shared)
            for both, a, b in shared:
                apart = np.bitwise_count(np.frombuffer(a[2], np.uint64) ^ np.frombuffer(b[2], np.uint64)).sum()
                assert apart * (100 + percent) <= (100 - percent) * (len(x) + len(y))


def test_op13_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.op13_ngram_jaccard(spark, d).collect()), key=str) == brute(rows, 4, 85)
