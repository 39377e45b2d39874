"""The training-data operators against brute force, libraries and exact round trips; nulls, ties, repeats, empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textquarry.llm import graph, jaccard, line_dedup, media, mixing, near_copies, packing, simhash, suffix_dedup, token_counts

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "a", "Ünï çödé ß Σας", "a<|endoftext|>b <|startoftext|>", "don't I'LL x y", "日本語 ok 1½", "x" * 3000, "the cat sat on the mat", "the cat sat on the mat"]
ODD_SCHEMA = "doc_id long, source string, text string, lang string, n_bytes string, score string, `start` int, kept string"


def odd(spark):
    return spark.createDataFrame([(i if i != 3 else None, None if i % 4 == 0 else f"s{i % 2}", t, None, "x", "y", 5, "k") for i, t in enumerate(ODD)], ODD_SCHEMA)


def test_line_dedup(spark):
    rows = [(i, "h", f"menu \nline {i}\n\nline {i % 9}") for i in range(40)] + [(100 + i, None, "menu\nx") for i in range(3)] + [(None, "h", None), (7, "h", "menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_dedup.drop_lines(df, ratio=0.5, min_pages=2).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is not None and r["source"]:
            assert "menu" not in r["text"] and r["n_dropped"] == 1
        if r["source"] is None:
            assert r["text"] == "" and r["n_dropped"] == 2
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_line_dedup_counts_copies_once(spark):
    import corpus_pipeline

    hot = "a text that is copied\nto a third of its host"
    rows = [(i, f"menu\nline {i}" if i < 40 else hot, "en", h, 1) for h in ("h", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_boilerplate(spark, df, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, hot if i >= 40 else f"line {i}") for i, *_ in rows)
    twice = df.unionByName(df).filter("doc_id < 3")
    assert [r["text"][:4] for r in corpus_pipeline.drop_boilerplate(spark, twice, "").collect()] == ["menu"] * 12  # 3 texts are fewer than 5 pages


def test_token_counts(spark):
    path = P.path("word_bpe_49k.json")
    prefixes = token_counts.loaded(path)
    count = lambda t: len(prefixes.library.encode(t, add_special_tokens=False).ids)
    for t in ODD:
        c = prefixes.counts(t)
        assert (int(c[-1]) if len(c) else 0) == count(t or "")
    text = "Thonre inand, the qqzzxw don't <|endoftext|>stop naïve"
    assert prefixes.counts(text).tolist() == [count(text[: i + 1]) for i in range(len(text))]
    rnd = random.Random(9)
    for _ in range(300):
        t = "".join(rnd.choices(["th", "e ", "in", " ", "\n", "'s", "\u00e9", "1", "\u00bd", ".", "\u4e2d", "Qx", "tion", "\u0301", "<|", "|>"], k=rnd.randint(1, 60)))
        assert int(prefixes.counts(t)[-1]) == count(t), t
    assert prefixes.tables(["zzyzx ", "zzyzx", "\t"])[0][:-2] == prefixes.tables(["zzyzx"])[0]
    got = token_counts.token_prefixes(odd(spark), path, budget=2).collect()
    assert token_counts.token_prefixes(odd(spark).limit(0), path).count() == 0
    assert sorted(r["n_tokens"] for r in got) == sorted(count(t or "") for t in ODD)
    for r in got:
        c = np.cumsum(np.frombuffer(r["prefix_steps"], "<i2"))
        assert len(c) == r["n_chars"] and r["fit_chars"] == max([i + 1 for i in range(len(c)) if c[i] <= 2], default=0)


def test_long_texts_are_read_in_parts(monkeypatch):
    rnd = random.Random(8)
    text = " ".join(rnd.choice(["one", "two's", "3", "r\u00e9el", "x-y.", "\n"]) for _ in range(400)) + "y" * 300
    prefixes, encoder = token_counts.loaded(P.path("word_bpe_49k.json")), packing.Encoder(P.path("byte_bpe_50k.json"))
    whole, ids = prefixes.counts(text).tolist(), encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    for module in (token_counts, packing):
        monkeypatch.setattr(module, "PART", 50)
    assert prefixes.counts(text).tolist() == whole and encoder.encode(text) == ids


def test_ranks_encode_like_the_library():
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"))
    assert encoder.ranked is not None
    for c in [*range(0x3100), *range(0x3100, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}b {chr(c)} 1{chr(c)}2  {chr(c)}{chr(c)}\n{chr(c)}'s{chr(c)}"
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.library.encode(t, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("codec", [None, "mulaw", "alaw", "ima_adpcm"])
def test_media(spark, codec):
    texts = [*ODD, *(f"some text {i} " * i for i in range(40)), "long é" * 30_000]
    df = spark.createDataFrame([(i, t, "x", b"clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string, `value` binary")
    stored = media.encode_media(df, codec=codec)
    held = {s["doc_id"]: s["media"] for s in stored.collect()}
    got = media.decode_media(stored).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)  # from the text, not from the container
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(want) and r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-64:]) and r["media_error"] is None and r["value"] == b"clash"
        m = held[r["doc_id"]]
        assert r["media_bytes"] == len(m) and r["media_sha256"] == hashlib.sha256(m).hexdigest()
        own, rate, block, data = media.read_wave(m)
        assert own == (codec or media.CODECS[zlib.crc32(want) % 3]) and rate == 8000
        if own == "ima_adpcm":
            assert all(data[i + 4 : i + block] == want[i // block * 64 :][:64] and data[i : i + 4] == bytes(4) for i in range(0, len(data), block))
        else:
            assert data == want
        pcm = np.frombuffer(r["pcm"], "<i2")
        lin = media.expand(own, data, block).astype(float)
        twice = np.append(np.stack([lin, np.append((lin[1:] + lin[:-1]) / 2, lin[-1])], axis=1).ravel(), [])
        assert np.array_equal(pcm, np.round(twice).astype(np.int16)) and f"n={len(pcm)} " in r["feature"]
    if codec is None:
        assert len({media.read_wave(m)[0] for m in held.values()}) == 3
    assert media.decode_media(media.encode_media(df.limit(0))).count() == 0


def test_media_tables_and_errors(spark, monkeypatch):
    t = media.EXPAND
    assert t["mulaw"][[0, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0] and t["alaw"][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    block = struct.pack("<hBB", 100, 10, 0) + bytes([0x70, 0x8F])
    value, index, want = 100, 10, [100]
    for code in (0, 7, 15, 8):
        step = int(media.STEPS[index])
        move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value, index = value + (-move if code & 8 else move), min(88, max(0, index + int(media.INDEX_STEP[code])))
        want.append(value)
    assert media.adpcm_blocks(block * 2, 6).tolist() == want * 2
    pcm = np.arange(-5000, 5000, 7).astype(np.int16)
    whole = media.resample(pcm, 8000, 11025)
    assert np.abs(whole - np.interp(np.arange(len(whole)) * 8000 / 11025, np.arange(len(pcm)), pcm)).max() <= 0.51
    for to in (16000, 24000):
        parts = [media.resample(pcm, 8000, to, i, i + 7) for i in range(0, len(pcm) * to // 8000, 7)]  # starts between samples too
        assert np.array_equal(media.resample(pcm, 8000, to), np.concatenate(parts))
    monkeypatch.setattr(media, "PIECE", 50)
    monkeypatch.setattr(media, "MANY", 1)
    assert media.adpcm_blocks(block * 2, 6).tolist() == want * 2
    assert np.array_equal(np.concatenate(list(media.resample_in_pieces(pcm, 8000, 11025))), whole)
    bad = media.decode_media(spark.createDataFrame([(bytearray(b"no"),)], "media binary")).first()
    assert bad["media_error"] and bad["payload_bytes"] is None


def brute_repeats(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [50_000, 1])
def test_suffix_dedup(spark, most):
    rnd = random.Random(5)
    base = "".join(rnd.choices("abcd ", k=900))
    texts = [base, base[:400] + "ZZ" + base[402:], base[100:350], "x" * 500, "x" * 210, "ab" * 150, base, "", None, "short", "é" * 150]
    for _ in range(25):
        t = list(base)
        for _ in range(4):
            t[rnd.randrange(len(t))] = rnd.choice("QRS")
        texts.append("".join(t[rnd.randrange(200) :]))
    df = spark.createDataFrame([(i if i != 2 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, name string")
    got = suffix_dedup.remove_repeats(df, most_shards=most).collect()
    want = brute_repeats([(t or "").encode() for t in texts], 200)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["name"] == "clash" for r in got)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [*ODD, *(" ".join(rnd.choices(words, k=60)) for _ in range(60))]
    for t in texts[-20:]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    assert [simhash.fingerprint(t) for t in texts] == [brute_simhash(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = [brute_simhash(t) for t in texts]
    up = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(up[j] for j in range(len(texts)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(texts))]
        if new == up:
            break
        up = new
    assert got == {i: (fp[i], up[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_copies(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    texts = [*ODD, *(" ".join(f"w{rnd.randrange(400)}" for _ in range(n)) for n in (40, 80, 120, 200, 1000) for _ in range(4))]
    for t in texts[len(ODD) :]:
        for edits in (1, 2, 3, len(t.split()) // 45, len(t.split()) // 30):
            w = t.split()
            for i in rnd.sample(range(len(w)), edits):
                w[i] = "changed"
            texts.append(" ".join(w))
    sets = [set(jaccard.shingles(t, near_copies.WORDS).tolist()) for t in texts]
    alike = [[j for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(texts))]
    between = [(i, j) for i in range(len(texts)) for j in alike[i] if i < j and len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j])]
    assert len(between) > 20  # pairs at 0.8 to 0.9
    up = list(range(len(texts)))
    while (new := [min(up[j] for j in alike[i]) for i in range(len(texts))]) != up:
        up = new
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(up))
    again = spark.createDataFrame([(7, "one text of its own, here for the first time", "en", "s", 1), (7, "no word in common with that", "en", "s", 1), (None, "x", "en", "s", 1)], df.schema)
    assert corpus_pipeline.drop_near_copies(spark, again.unionByName(again), "").count() == 3  # both texts of the repeated id stay, and one of the rows alike
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("limit", [2048, 4])
def test_close_pairs_lose_nothing(limit):
    rnd = np.random.default_rng(3)
    fp = np.unique(np.r_[rnd.integers(0, 2**63, 50).astype(np.uint64), (np.uint64(77) ^ (np.uint64(1) << rnd.integers(0, 64, 60).astype(np.uint64)))])
    found = set()
    for a, b in simhash._close(np.zeros(len(fp), np.int64), fp, 2, limit):
        found |= {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {frozenset((i, j)) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert found == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(80)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_mixing(spark):
    rnd = random.Random(13)
    for _ in range(60):  # the flow meets as much of the quotas as can be, at the least cost, by trying all
        patterns = [(tuple(sorted(rnd.sample("abc", rnd.randint(1, 3)))), rnd.randint(0, 2)) for _ in range(2)]
        quotas = {k: rnd.randint(0, 4) for k in "abc"}
        most = [3 * n for _, n in patterns]
        cost = lambda flow: sum(sum(1 + i // n for i in range(f)) for f, (_, n) in zip(flow, patterns, strict=True) if n)

        def fits(flow, patterns=patterns, quotas=quotas):
            """Whether patterns can give so much: no set of patterns gives more than the sources it reaches take (Hall)."""
            sets = [[0], [1], [0, 1]]
            return all(sum(flow[i] for i in own) <= sum(quotas[k] for k in {k for i in own for k in patterns[i][0]}) for own in sets)

        every = [(x, y) for x in range(most[0] + 1) for y in range(most[1] + 1) if fits((x, y))]
        best = max(map(sum, every))
        got = mixing.min_cost_flow(patterns, quotas)
        assert sum(got) == best and fits(got) and cost(got) == min(cost(f) for f in every if sum(f) == best)
    assert mixing.min_cost_flow([(("a",), 10)], {"a": 100}) == [30]
    rows = [(i, f"s{i % 4}" if i % 5 else None, " ".join(["w"] * (i % 17))) for i in range(300)] + [(1, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed_documents(df).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        source = rows[r["doc_id"]][1]
        taken[source] += r["taken"]
        sizes[source], targets[source] = r["source_size"], r["target"]
    for s, n in taken.items():
        assert abs(n - targets[s]) <= 1 and targets[s] <= 3 * sizes[s] + 1e-6
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(tuple, mixing.mixed_documents(df.repartition(7)).collect())) == sorted(map(tuple, got))
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "word " * 3000, *(f"some text number {i} " * (i % 50) for i in range(120))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, `length` int")
    got = packing.pack_documents(df, path).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist() and sum(p["length"] for p in pieces) == len(ids) == pieces[0]["doc_tokens"]
        assert all(zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    for places in by_seq.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) <= 1024
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= 1.05 * total / 1024 + 1


def test_best_fit_is_best_fit():
    rnd = random.Random(6)
    lengths = sorted((rnd.randint(1, 60) for _ in range(400)), reverse=True)
    open_ = []
    for n in lengths:
        fit = [r for r in open_ if r >= n]
        r = min(fit) if fit else 64
        if fit:
            open_.remove(r)
        open_.append(r - n)
    plan = packing.best_fit_plan(Counter(lengths), 64)
    made = Counter()
    for length, a, b, first, offset in plan:
        for k in range(b - a):
            made[first + k] += length
    assert sorted(64 - v for v in made.values()) == sorted(open_)


def test_mix_takes_whole_documents(spark):
    import corpus_pipeline

    rows = [(i, f"first line {i}\n\nsecond  line " + "w " * (i % 7), "en", f"s{i % 3}", 1) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    assert got and all(tuple(r) == rows[r["doc_id"]] for r in got)
    for t in mixing.mixed_documents(df).join(df.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect():
        words = sum(len(r["text"].split()) for r in got if r["source"] == t["source"])
        assert t["target"] - 1 <= words < t["target"] + 12


def test_mix_tells_rows_with_one_id_apart(spark):
    import corpus_pipeline

    rows = [(None if i % 2 else 5, f"text {i} of three {i % 4}", "en", f"s{i % 4}", 1) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, df.unionByName(df.limit(1)), "").collect()
    assert {tuple(r) for r in got} <= set(rows)
    words = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in ("s0", "s1", "s2", "s3")}
    for t in mixing.mixed_documents(df.unionByName(df.limit(1)).select(F.col("source").alias("doc_id"), "source", "text")).select("doc_id", "target").distinct().collect():
        assert t["target"] - 1 <= words[t["doc_id"]] < t["target"] + 6


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    from pathlib import Path

    if not Path(sf).is_dir():
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = corpus_pipeline.settled(lambda out=out: out)
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
