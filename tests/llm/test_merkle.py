"""The manifest against a tree built by hand, and against its SQL."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from textquarry.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """The root, and the siblings of each leaf with whether they stand left."""
    paths, at, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        for k, own in enumerate(at):
            for i in own:
                other = level[k ^ 1] if k ^ 1 < len(level) else ""
                paths[i].append((other, bool(k & 1 and other)))
        at = [at[i] + (at[i + 1] if i + 1 < len(at) else []) for i in range(0, len(at), 2)]
        level = [h(*p) for p in pairs]
    return level[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted([r for r in rows if r[2] == g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in own[g]]) for g in langs}
    root, over = tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, over, strict=True):
        for r, path in zip(own[g], trees[g][1], strict=True):
            whole = path + up
            made = leaf((*r[:3], r[3] + 1, r[4])) if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for d, left in whole:
                made = h(d, made) if left else h(made, d)
            out.append((r[0], leaf(r), trees[g][0], root, h(*[d for d, _ in whole]), made, made == root))
    return sorted(out, key=str)


def query(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'own' AS tree", "'own' AS pos", "'own' AS digest", "1 AS n", "'own' AS leaf")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 257, 700])
def test_one_tree(spark, tmp_path, n):
    rows = [(i * 3 + 1, "s", "en", i, f"text {i}") for i in range(n)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "x"), (5, "s", "", 1, ""), *[(6, "é", "en", 2, "the same row")] * 5, (6, "other", "en", 2, "the same id"), (7, "s", "en", None, "no count"), (8, "s", "en", 9, "long " * 100_000)]
    rows += [(100 + i, "s", lang, i, str(i)) for i in range(300) for lang in ("fr", "zz", "éé")]
    assert query(spark, rows, tmp_path, extra=True) == brute(rows)


def test_many_groups_and_no_rows(spark, tmp_path):
    rows = [(i, "s", f"g{i % 300:03d}", i, str(i)) for i in range(900)]
    assert query(spark, rows, tmp_path / "a") == brute(rows)
    assert query(spark, [], tmp_path / "b") == []


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(i, "s" if i % 3 else None, [None, "en", "fr", ""][i % 4], i if i % 5 else None, f"text {i}") for i in range(120)]
    got = query(spark, rows, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(merkle.OP12_SQL).fetchall(), key=str) == got


def test_tampering_with_any_field_shows(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(20)]
    told = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 4).withColumn("made", merkle.folded(F.col("now"), F.col("path")))
    assert {r["doc_id"] for r in told.filter("made <> root").collect()} == {4}
