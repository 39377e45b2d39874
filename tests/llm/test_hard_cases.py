"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textquarry.llm import line_dedup, media, mixing, packing, simhash, suffix_dedup, token_counts

P = pytest.importorskip("public_tokenizers")
LONG = "a very long text, " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the river and the sea\nfoot", "en", "s0", 1),
    (1, "another text with the same id\nfoot", "en", "s0", 1),
    (None, "a text without an id is a text too\nfoot", "en", "s0", 1),
    (None, None, None, None, None),
    (2, None, "en", "s0", 1),
    (3, "", "en", "s0", 1),
    (4, " \n\t", None, "s1", None),
    (5, LONG, "en", "s1", 1),
    (6, LONG + "end", "en", None, 1),
    *[(7, "the same row three times\nfoot", "fr", "s0", 1)] * 3,
    *[(10 + i, f"row {i} of many that end alike\nfoot", "fr", "s0", 1) for i in range(12)],
    (40, "½ ² 123", "en", "s1", 1),
    (41, "<|endoftext|> as text <|startoftext|>", "en", "s1", 1),
]
CLASH = ["key", "host", "line", "salt", "drop", "value", "fp", "row", "start", "length", "size", "n_bytes", "target", "_rank", "_salt_of_row", "name", "data", "who", "copies"]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(hard):
    return hard.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH], F.lit("dotted").alias("a.b"), F.lit("quoted").alias("a`b"))


def kept(df, *replaced):
    """The clashing columns still hold their own values."""
    names = [c for c in CLASH if c in df.columns and c not in replaced]
    assert names and all(r[c] == f"own {c}" for r in df.select(*names).collect() for c in names)
    assert {"a.b", "a`b"} <= set(df.columns)


def test_line_dedup(spark, hard, clashing):
    hosts, pages = Counter(), defaultdict(Counter)
    for _, t, _, s, _ in ROWS:
        hosts[s] += 1
        pages[s].update({x.strip(" \t\r") for x in t.split("\n")} if t is not None else ())
    bad = {(s, x) for s in pages for x, n in pages[s].items() if x and n >= 5 and n > 0.5 * hosts[s]}
    assert bad == {("s0", "foot")}
    want = sorted((str(i), str(s), None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad)) for i, t, _, s, _ in ROWS)
    got = line_dedup.drop_lines(hard, ratio=0.5)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["text"]) for r in got.collect()) == sorted(want, key=str) or sorted(((str(r["doc_id"]), str(r["source"]), r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    out = line_dedup.drop_lines(clashing, ratio=0.5)
    kept(out)
    assert out.count() == len(ROWS) and line_dedup.drop_lines(clashing.limit(0)).count() == 0


def test_token_counts_and_media(clashing):
    path = P.path("word_bpe_49k.json")
    library = token_counts.loaded(path).library
    out = token_counts.token_prefixes(clashing, path)
    kept(out, "n_bytes")
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in ROWS)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out.select("n_bytes", "n_tokens").collect()) == want
    out = media.decode_media(media.encode_media(clashing))
    kept(out, "n_bytes")
    sha = lambda t: hashlib.sha256((b := (t or "").encode()) + b"\0" * (-len(b) % 64 if b else 64)).hexdigest()
    assert sorted(r[0] for r in out.select("payload_sha256").collect()) == sorted(sha(t) for _, t, *_ in ROWS)
    assert media.decode_media(media.encode_media(clashing.limit(0))).count() == 0


def test_suffix_dedup(clashing):
    out = suffix_dedup.remove_repeats(clashing, keep_text=False)
    kept(out, "n_bytes")
    got = {r["doc_id"]: r for r in out.filter("doc_id > 4").collect()}
    assert out.count() == len(ROWS) and suffix_dedup.remove_repeats(clashing.limit(0)).count() == 0
    assert got[5]["n_removed"] == len(LONG) and got[6]["n_removed"] >= len(LONG) and got[10]["n_removed"] == 0  # the long text repeats itself


def test_simhash(spark, hard, clashing):
    def fp(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if len(h) < 500 else None

    fps = [fp(t) for _, t, *_ in ROWS]
    rows = [(r, f) for r, f in zip(ROWS, fps, strict=True) if f is not None]
    up = list(range(len(rows)))
    while (new := [min(up[j] for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2) for i in range(len(rows))]) != up:
        up = new
    least = {k: min((rows[i][0][0] for i in range(len(rows)) if up[i] == k and rows[i][0][0] is not None), default=None) for k in set(up)}
    want = sorted((str(r[0]), f"{f:016x}", str(least[up[i]])) for i, (r, f) in enumerate(rows))
    got = simhash.near_duplicates(clashing).filter("doc_id IS NULL OR doc_id NOT IN (5, 6)").collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(clashing.limit(0)).count() == 0


def test_mixing(hard, clashing):
    got = mixing.mixed_documents(clashing).collect()
    words = lambda t: len((t or "").split())
    assert sorted(r["size"] for r in got) == sorted(words(t) for _, t, *_ in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, mixing.mixed_documents(hard.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mixed_documents(clashing.limit(0)).count() == 0


def test_packing(clashing):
    path = P.path("byte_bpe_50k.json")
    library = packing.Encoder(path).library
    got = packing.pack_documents(clashing, path).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(str(i), s, zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    assert packing.pack_documents(clashing.limit(0), path).count() == 0


def test_pipeline_stages(spark, hard):
    import corpus_pipeline as c

    more = hard.withColumn("row", F.lit("own")).withColumn("copies", F.lit(5)).withColumn("score", F.lit("x"))
    held = c.identify(spark, more, "")
    assert held.columns == more.columns and {r["doc_id"] for r in held.collect()} >= {1, 5, 6, 7} and held.filter("text IS NULL OR doc_id IN (3, 4, 40)").count() == 0
    held = c.drop_boilerplate(spark, more, "")
    assert held.columns == more.columns and held.count() == len(ROWS)
    held = c.drop_near_copies(spark, more, "")
    got = held.collect()
    assert held.columns == more.columns and len({tuple(r) for r in got}) == len(got)
    texts = Counter(r["text"] for r in got)
    assert max(texts.values()) == 1 and {t for _, t, *_ in ROWS if t and t.strip()} - set(texts) <= {LONG, LONG + "end"}
    assert sum(t in (LONG, LONG + "end") for t in texts) == 1 and sum(not (t or "").strip() for t in texts) == 1
    held = c.mix_sources(spark, more, "")
    assert held.columns == more.columns and {tuple(r)[:5] for r in held.collect()} <= {tuple(r) for r in ROWS}
    assert c.pack(spark, more, "").count() >= len(ROWS)
    for _, stage in c.STAGES:
        assert stage(spark, more.limit(0), "").count() == 0


def test_pipeline_on_an_empty_table_and_twice(spark, hard, tmp_path):
    import corpus_pipeline as c

    hard.limit(0).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert c.run(spark, str(tmp_path / "empty")).count() == 0
    hard.write.parquet(str(tmp_path / "some/documents.parquet"))
    first, second = (sorted(map(tuple, c.run(spark, str(tmp_path / "some")).collect()), key=str) for _ in range(2))
    assert first and [r[:5] for r in first] == [r[:5] for r in second]
