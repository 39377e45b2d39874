"""Language identification against a brute-force version of its scores, held-out accuracy, and the sample's bound."""

import math
import random
import time
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textquarry.llm import language_id

VOCAB = {"en": "the and of that with this from have there which".split(), "fr": "le la les des une dans pour avec être très".split(), "xx": "ąžu ėjo naktį kūrė".split()}


def texts(n, seed=1, langs=("en", "fr")):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(VOCAB[k], k=20)), k) for i in range(n) for k in [rnd.choice(langs)]]


def words(text):
    out, held = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and held):
            held += c
        elif held:
            out.append(held)
            held = ""
    return out


def brute(train, text, lengths=(5, 4, 3, 2, 1)):
    langs = sorted({k for _, _, k in train})
    count = {k: Counter(w for _, t, l in train if l == k for w in words(t)) for k in langs}
    grams = {k: Counter() for k in langs}
    for k in langs:
        for w, n in count[k].items():
            p = f" {w} "
            for m in lengths:
                for i in range(len(p) - m + 1):
                    grams[k][p[i : i + m]] += n
    total = {k: sum(count[k].values()) for k in langs}
    by = {k: {m: sum(n for g, n in grams[k].items() if len(g) == m) for m in lengths} for k in langs}
    lowest = -1 - math.log10(max(total.values()))
    log = lambda n, all_: math.log10(n / all_) if n else lowest
    sums, own = dict.fromkeys(langs, 0.0), words(text)
    for w in own:
        known, p = [], f" {w} "
        if not any(w in count[k] for k in langs):
            for m in lengths:
                known = [p[i : i + m] for i in range(len(p) - m + 1) if any(p[i : i + m] in grams[k] for k in langs)]
                if known:
                    break
        for k in langs:
            if any(w in count[x] for x in langs):
                sums[k] += log(count[k][w], total[k])
            else:
                sums[k] += sum(log(grams[k][g], by[k][len(g)]) for g in known) / len(known) if known else lowest
    if not own:
        return "und", 0.0
    mean = {k: v / len(own) for k, v in sums.items()}
    best = max(langs, key=lambda k: (mean[k], [-ord(c) for c in k]))
    return best, 1 / sum(math.exp((m - mean[best]) * math.log(10) * math.sqrt(len(own))) for m in mean.values())


ODD = [None, "", "123 ... ½ ² Ⅷ", "x", "thé LES", "therewith andes", "ąžuolas été", "日本", "le" * 3000, "the\nand THE", "a" * 200, "́́"]


def test_scores_are_those_of_brute_force(spark):
    train = texts(60)
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(i, t, "x", 1.5) for i, t in enumerate([*ODD, *(t for _, t, _ in texts(20, 7)), *ODD])]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, value double"), model).collect()
    assert len(got) == len(rows) and {r["value"] for r in got} == {1.5}
    for r in got:
        lang, score = brute(train, r["text"] or "")
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-9), r["text"]


def test_parts_and_ring(spark, monkeypatch):
    model = language_id.fit(spark.createDataFrame(texts(60), "doc_id long, text string, lang string"))
    many = [" ".join(f"the{a}{b}" for a in "abcdefghij" for b in "klmnopq") for _ in range(3)] + ["andes " * 50, "the and of"]
    want = model.predict(many)
    monkeypatch.setattr(language_id, "PART", 40)
    model.index, model.cache_size = None, 7
    for _ in range(2):
        got = model.predict(many)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_sample_has_a_bound_and_every_language(spark):
    rows = texts(50) + [(100 + i, "the and of the", "en") for i in range(100)] + [(7, "the and of the", "en")] * 100 + [(500, " ".join(VOCAB["xx"]), "xx"), (501, None, "yy"), (502, "zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, docs_each=10)
    assert model.langs == ["en", "fr", "xx"] and model.predict(["ėjo"])[0][0] == "xx"
    for k, bound in ((10, 10), (1000, 1000)):
        model = language_id.fit(df.filter("lang = 'en'"), docs_each=k)
        held = sum(round(10 ** (v + model.lowest) * 1e6) for v in model.base.value.tolist())
        assert abs(held - 1e6) < 20 and len(model.words) <= 20 * bound
    assert language_id.fit(df.limit(0)).predict(["the", None]) == [("und", 0.0)] * 2
    assert language_id.predict(df.limit(0), model).count() == 0


def test_thousands_of_labels(spark):
    """Counts are sparse: three thousand labels fit in seconds, each is learned, and the sample's bound holds over all."""
    own = lambda k: "own" + "".join(chr(97 + int(x)) for x in f"{k:04d}")
    rows = [(i, f"shared words {own(k)} and again {own(k)} {i}", f"l{k:04d}") for i, k in enumerate(k for k in range(3000) for _ in range(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    start = time.monotonic()
    model = language_id.fit(df, docs_most=6000)
    took = time.monotonic() - start
    assert took < 60, took
    assert len(model.langs) == 3000 and len(model.base.value) < 10 * len(rows)
    got = model.predict([r[1] for r in rows[::100]])
    assert [g[0] for g in got] == [r[2] for r in rows[::100]]
    one = language_id.fit(df, docs_most=3000)
    assert len(one.langs) == 3000 and sum(round(x) for x in counted(one)) == 3000 * 6


def counted(model):
    """Words of the sample by language, from the model: each sampled text here has the word "shared" once."""
    at = model.words.index("shared")
    own = slice(model.base.start[at], model.base.start[at] + model.base.size[at])
    return 10 ** -(model.base.value[own] + model.lowest)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    if not Path(sf).is_dir():
        pytest.skip("no driver tables")
    got = language_id.op2_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    own = got.filter("held_out").join(docs, "doc_id")
    assert got.count() == docs.count() and own.count() > 100
    assert own.filter("lang_pred = lang").count() >= 0.97 * own.count()
    assert got.filter(F.col("score") < 0).count() == 0
