"""Language identification by word-first backoff.

A word is a letter with the letters and marks after it, in lower case; fitting and prediction share that rule. A word that
the model knows scores by its log frequency in each language. An unseen word falls back to its character n-grams, the
longest first: the first length of which the model knows any n-gram scores it by the mean over the n-grams it has of that
length. A text's score in a language is the mean over its words; the confidence is the share of the best language when
the means, weighted by the root of the number of words, are read as log likelihoods.

Fitting: word and n-gram counts are aggregations over a sample of labelled rows: for each label value the ``docs_each``
rows with the smallest hashes of id and text (fewer where the labels are so many that this would pass ``docs_most`` in all),
so a rare language is learned whatever its share, the bound is exact however often a text is copied, and the model (all words
and n-grams of the sample, with a count for each language that has them, not for the others) has a size that does not grow
with the corpus. Prediction covers all rows and shuffles nothing.

Cases: null text or one without letters is ``und`` with score 0; ties go to the language that is first by code point;
repeated rows are scored alike; without labelled rows every text is ``und``; very long texts are read in parts; an empty
table gives an empty table; further columns pass through, one named like a result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, per_value, table

#: The same rule twice: in Latin-1 there are no marks, and plain ``re`` is faster there.
_WORD, _LATIN_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile("[a-zªµºß-öø-ÿ]+")
_BREAK = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])")
UNKNOWN = "und"
#: Code points of texts whose words are looked up at once.
PART = 1 << 20


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    try:
        low.encode("latin-1")
        return _LATIN_WORD.findall(low)
    except UnicodeEncodeError:
        return _WORD.findall(low)


def _parts(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PART:
        m = _BREAK.search(text, at + PART)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


class Rows:
    """Sparse rows over languages: of word or n-gram i the entries start[i] to start[i] + size[i] of lang and value."""

    def __init__(self, size: np.ndarray, lang: np.ndarray, value: np.ndarray):
        self.start, self.size, self.lang, self.value = np.cumsum(size) - size, size, lang, value

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the rows at, row by row, and how many each has."""
        n = self.size[at]
        return np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def joined(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate([getattr(x, k) for x in (self, other)]) for k in ("size", "lang", "value")))


class Model:
    """Log10 frequencies of words and n-grams in each language, sparse: a value is what the frequency is above ``lowest``, which stands for none.

    words and grams: name, and a row for each language that has it (by place in langs) with its count, as (names, size, lang, count).
    """

    def __init__(self, langs: list[str], words: tuple = ([], *[np.zeros(0, np.int64)] * 3), grams: tuple = ([], *[np.zeros(0, np.int64)] * 3), lengths: tuple[int, ...] = (5, 4, 3, 2, 1), cache: int = 200_000):
        self.langs, self.lengths, self.cache_size = langs, lengths, cache
        self.words, size, lang, count = words
        totals = np.bincount(lang, count, len(langs))
        self.lowest = -1.0 - np.log10(max(1.0, float(totals.max(initial=0))))
        self.base = Rows(size, lang, np.log10(count / totals[lang]) - self.lowest)
        names, size, lang, count = grams
        place = lang * (max(lengths) + 1) + np.repeat(np.array([len(g) for g in names], np.int64), size)
        by_length = np.bincount(place, count, len(langs) * (max(lengths) + 1))
        self.grams, self.gram_rows = {g: i for i, g in enumerate(names)}, Rows(size, lang, np.log10(count / by_length[place]) - self.lowest)
        self.index: dict[str, int] | None = None

    def _start(self) -> None:
        """The words' rows, which those of unseen words follow until there are too many; then it starts anew."""
        self.index, self.rows = {w: i for i, w in enumerate(self.words)}, self.base

    def _back_off(self, unseen: list[str]) -> Rows:
        """A row for each unseen word: the mean of the n-grams it has of the longest known length."""
        get, found, counts = self.grams.get, [], []
        for word in unseen:
            padded, known = f" {word} ", []
            for n in self.lengths:
                known = [g for i in range(len(padded) - n + 1) if (g := get(padded[i : i + n])) is not None]
                if known:
                    break
            found += known
            counts.append(len(known))  # nothing known: as rare as can be in every language
        n = np.array(counts, np.int64)
        owner = np.repeat(np.arange(len(unseen)), n)
        entry, each = self.gram_rows.entries(np.array(found, np.int64))
        owner = np.repeat(owner, each)
        names, at = np.unique(owner * len(self.langs) + self.gram_rows.lang[entry], return_inverse=True)
        value = np.bincount(at, self.gram_rows.value[entry], len(names))
        word, lang = np.divmod(names, len(self.langs))
        return Rows(np.bincount(word, minlength=len(unseen)), lang, value / np.maximum(n, 1)[word])

    def _places(self, words: list[str]) -> np.ndarray:
        """The words' rows in self.rows."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(at < 0)
        if not len(missed):
            return at
        new = list(dict.fromkeys([words[i] for i in missed.tolist()]))
        if len(self.index) > len(self.words) and len(self.index) + len(new) > len(self.words) + self.cache_size:
            self._start()
            return self._places(words)
        first = len(self.index)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        self.rows = self.rows.joined(self._back_off(new))
        at[missed] = [self.index[words[i]] for i in missed.tolist()]
        return at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.index is None:
            self._start()
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        words: list[str] = []
        owners: list[int] = []
        ends: list[int] = []
        chars = 0

        def flush() -> None:
            if words:
                each = np.diff(np.r_[0, ends])
                at = self._places(words)
                entry, size = self.rows.entries(at)
                first = owners[0]  # the texts since the last flush follow each other
                place = np.repeat(np.repeat(np.array(owners) - first, each), size) * len(self.langs) + self.rows.lang[entry]
                more = owners[-1] - first + 1
                total[first : first + more] += np.bincount(place, self.rows.value[entry], more * len(self.langs)).reshape(more, -1)
                np.add.at(n, owners, each)
            words.clear(), owners.clear(), ends.clear()

        for i, text in enumerate(texts if self.langs else []):
            for part in _parts(text) if text else []:
                if own := words_of(part):
                    words.extend(own)
                    owners.append(i)
                    ends.append(len(words))
                chars += len(part)
                if chars >= PART:
                    flush()
                    chars = 0
        flush()
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        mean = self.lowest + total / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        share = 1 / np.exp((mean - mean.max(axis=1, keepdims=True)) * np.log(10) * np.sqrt(n)[:, None]).sum(axis=1)
        return [(self.langs[b], s) if k else (UNKNOWN, 0.0) for b, s, k in zip(best.tolist(), share.tolist(), n.tolist(), strict=True)]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = 1_000, lengths: tuple[int, ...] = (5, 4, 3, 2, 1), docs_most: int = 50_000) -> Model:
    """A model from at most docs_each labelled rows of each language, and docs_most in all, but one of each; lengths: those of
    the n-grams, as they are tried."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.xxhash64(key, text).alias("h"), F.col(key).alias("k"), F.col(text).alias("t"))
    n_langs = rows.select("l").distinct().count()
    docs_each = min(docs_each, max(1, docs_most // max(1, n_langs)))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))
    narrow = rows.select("l", "h", "k").withColumn("s", F.pmod("h", F.lit(64)))  # hashes are sorted, not texts; in slices first
    in_slice = F.row_number().over(Window.partitionBy("l", "s").orderBy("h", "k"))
    least = narrow.withColumn("n", in_slice).filter(F.col("n") <= docs_each).withColumn("n", first).filter(F.col("n") <= docs_each)
    marks = [tuple(r) for r in least.groupBy("l").agg(F.max("h")).collect()]  # a row for each language
    near = rows.join(F.broadcast(rows.sparkSession.createDataFrame(marks, "l string, mark long")), "l").filter("h <= mark")
    sample = near.withColumn("n", first).filter(F.col("n") <= docs_each).select("l", "t")
    counted = per_value(sample, "t", {"w": "string", "n": "long"}, lambda: lambda t: list(Counter(words_of(t)).items()), many=True)
    counts = materialise(counted.groupBy("l", "w").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("l").distinct().collect())  # a row for each language
    if not langs:
        return Model([], lengths=lengths)
    padded = counts.withColumn("p", F.concat(F.lit(" "), "w", F.lit(" ")))

    def of_length(k: int) -> Column:
        """The n-grams of one length. (A lambda's second parameter would be the element's index.)"""
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - (k - 1), F.lit(1))), lambda i: F.substring(F.col("p"), i, F.lit(k)))
        return F.filter(each, lambda g: F.length(g) == k)

    pieces = F.flatten(F.array(*map(of_length, lengths)))
    grams = padded.select("l", "n", F.explode(pieces).alias("w"))

    def sparse(df: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Bounded by the sample: a row for each language of each word or n-gram in it."""
        t = df.groupBy("w", "l").agg(F.sum("n").alias("n")).orderBy("w", "l").toArrow().combine_chunks()
        word, lang = (t[k].combine_chunks().dictionary_encode() for k in ("w", "l"))
        place = {x: i for i, x in enumerate(langs)}
        place = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)
        names = word.dictionary.to_pylist()  # in order, as the rows are
        return names, np.bincount(word.indices.to_numpy(), minlength=len(names)), place[lang.indices.to_numpy()], t["n"].to_numpy()

    model = Model(langs, sparse(counts), sparse(grams), lengths)
    forget(counts)
    return model


def predict(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return per_value(df, text, {"lang_pred": "string", "score": "double"}, lambda: shared.value.predict, keep=keep_text, together=True)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
