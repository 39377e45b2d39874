"""Sentence ends learned from the corpus itself: abbreviations and sentence starters by log-likelihood ratios (Kiss and Strunk, 2006).

A word that nearly always has a period after it, is short and holds periods inside is an abbreviation; a word that follows
sentence ends far more often than chance has it is a starter. The counts are partial aggregations over all texts, so a
frequent word is no hot key; the model is the few words over the thresholds, and is applied in columns.

Cases: null and blank texts have no words; words without a letter are not learned from; an empty table gives an empty model,
with which every period ends a sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written

#: Thresholds and the chance of a period after an abbreviation, as published (fixed values).
ABBREVIATION, STARTER, WITH_PERIOD = 0.3, 30.0, 0.99
#: A model of more words than this is no model of abbreviations, and is not sent to the tasks.
MOST = 20_000
_OPEN, _CLOSE, _CLOSING = r"""^[("'\[]+""", r"""[)"'\],;:]+$""", ")\"'],;:"


def core(word: Column) -> Column:
    """A word without brackets, quotes and commas around it."""
    return F.regexp_replace(F.regexp_replace(word, _OPEN, ""), _CLOSE, "")


def word_type(word: Column) -> Column:
    """Lower case, without a last period."""
    return F.regexp_replace(F.lower(core(word)), r"\.$", "")


def _xlog(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def _may_end(word: Column) -> Column:
    """core(word).rlike("[.!?]$"), without regular expressions."""
    return F.right(F.rtrim(word, F.lit(_CLOSING)), F.lit(1)).isin(".", "!", "?")


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """w, after, n: how often each word as written follows each word that may end a sentence (null: any other, or none).

    The regular expressions then see each of these once, not each of the texts' words.
    """

    def pair(w: Column, before: Column) -> Column:
        return F.struct(w.alias("w"), F.when(_may_end(before), before).alias("after"))

    pairs = F.zip_with("w", F.concat(F.array(F.lit(None).cast("string")), "w"), pair)
    each = docs.select(T.words(F.col(text)).alias("w")).select(F.explode(pairs).alias("x")).select("x.*").filter("w IS NOT NULL")
    return each.groupBy("w", "after").agg(F.count(F.lit(1)).alias("n"))


def _typed(counted: DataFrame) -> DataFrame:
    """counted with type, for words with a letter."""
    return counted.withColumn("type", word_type(F.col("w"))).filter(F.col("type").rlike(r"\p{L}"))


def abbreviation_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """type, n, with_period, score of all types that a period follows at least once."""
    return _abbreviations(_counted(docs, text))


def _abbreviations(counted: DataFrame) -> DataFrame:
    each = _typed(counted.groupBy("w").agg(F.sum("n").alias("n")))
    counts = each.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(core(F.col("w")).endswith("."), F.col("n")).otherwise(0)).alias("with_period"))
    total = counts.agg(F.sum("n").alias("_n"), F.sum("with_period").alias("_p"))  # one row
    own = counts.filter("with_period > 0").join(F.broadcast(total))
    p, other = F.col("_p") / F.col("_n"), F.col("n") - F.col("with_period")
    null = _xlog(F.col("with_period"), p) + _xlog(other, 1 - p)
    alt = F.col("with_period") * F.log(F.lit(WITH_PERIOD)) + other * F.log(F.lit(1 - WITH_PERIOD))
    letters, inner = F.length(F.replace("type", F.lit("."), F.lit(""))), F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    score = -2 * (null - alt) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -other)
    return own.select("type", "n", "with_period", (F.round(score, 6) + 0.0).alias("score"))  # no negative zero


def starter_scores(docs: DataFrame, abbreviations: list[str] | DataFrame, text: str = "text") -> DataFrame:
    """type, n, at_start, score: how much more often than chance has it a type follows a sentence end. abbreviations: a list, or a table (type) of any size."""
    if isinstance(abbreviations, list):
        abbreviations = docs.sparkSession.createDataFrame([(a,) for a in abbreviations], "type string")
    return _starters(_counted(docs, text), abbreviations)


def _starters(counted: DataFrame, abbreviations: DataFrame) -> DataFrame:
    short = abbreviations.select(F.col("type").alias("_ended")).distinct()
    after = counted.filter("after IS NOT NULL").withColumn("_ended", word_type(F.col("after"))).join(short, "_ended", "left_anti")
    ends = after.groupBy("w").agg(F.lit(0).cast("long").alias("n"), F.sum("n").alias("at_start"))
    each = counted.groupBy("w").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("at_start")).unionByName(ends)
    counts = _typed(each).groupBy("type").agg(F.sum("n").alias("n"), F.sum("at_start").alias("at_start"))
    total = counts.agg(F.sum("n").alias("_n"), F.sum("at_start").alias("_a"))  # one row
    own = counts.filter("at_start > 0").join(F.broadcast(total))
    b, ab, a, n = (F.col(c).cast("double") for c in ("n", "at_start", "_a", "_n"))
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(0.0)
    null = _xlog(b, p) + _xlog(n - b, 1 - p)
    alt = _xlog(ab, p1) + _xlog(a - ab, 1 - p1) + _xlog(b - ab, p2) + _xlog(n - a - b + ab, 1 - p2)
    return own.filter(p1 > p).select("type", "n", "at_start", F.round(-2 * (null - alt), 6).alias("score"))


def learned_tables(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The abbreviation scores, and the starter scores that these give: tables of any size, from one pass over the texts.

    They, and the counts that both rest on, are written to the shared folder.
    """
    counted = written(_counted(docs, text))
    abbreviations = written(_abbreviations(counted))
    return abbreviations, _starters(counted, _over(abbreviations, ABBREVIATION))


def _over(scores: DataFrame, least: float) -> DataFrame:
    return scores.filter(F.col("score") >= least).select("type")


@dataclass
class Model:
    abbreviations: list[str]
    starters: list[str]


def _bounded(scores: DataFrame, least: float) -> list[str]:
    rows = [r[0] for r in scores.filter(F.col("score") >= least).select("type").limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} words over the threshold: raise it, or learn from plainer texts")
    return sorted(rows)


def learn(docs: DataFrame, text: str = "text") -> Model:
    found = _bounded(abbreviation_scores(docs, text), ABBREVIATION)
    return Model(found, _bounded(starter_scores(docs, found, text), STARTER))


def _among(value: Column, words: list[str]) -> Column:
    return value.isin(words) if words else F.lit(False)


def _spans(words: DataFrame, ends: Column, out: str) -> DataFrame:
    """words (_w) with the sentences that end at the words marked; in steps, each a column, so that nothing is worked out twice."""
    at = F.filter(F.transform("_e", lambda e, i: F.when(e, i + 1)), lambda i: i.isNotNull())  # places after which a sentence ends
    told = words.withColumn("_e", ends).withColumn("_at", at)
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0)))), "_at", lambda a, b: F.array_join(F.slice("_w", a + 1, b - a), " "))
    made = F.when(F.size("_w") > 0, spans).otherwise(F.array().cast("array<string>"))
    return told.withColumn(out, made).drop("_w", "_e", "_at")


def _following() -> Column:
    return F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0)))


def sentences(docs: DataFrame, model: Model, text: str = "text", out: str = "sentences") -> DataFrame:
    """docs with their sentences, white space inside made one space. A period ends one unless its word is an abbreviation; after
    that, only before a capital that begins a starter. Exclamation and question marks always do.

    In steps, each a column, so that the words of a text are taken apart once.
    """

    def end(own: Column, following: Column) -> Column:
        short = core(own).endswith(".") & _among(word_type(own), model.abbreviations)
        begins = core(following).rlike(r"^\p{Lu}") & _among(word_type(following), model.starters)
        return following.isNull() | (core(own).rlike(r"[.!?]$") & (~short | F.coalesce(begins, F.lit(False))))

    return _spans(docs.withColumn("_w", T.words(F.col(text))), F.zip_with("_w", _following(), end), out)


def sentences_by(docs: DataFrame, abbreviations: DataFrame, starters: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """As sentences, by tables (type) of abbreviations and starters of any size: nothing of them passes through the driver.

    The periods that end no sentence are found by joins on types, and meet the texts by digest, so that equal texts share them.
    """
    words = docs.withColumn("_w", T.words(F.col(text))).withColumn("_d", F.md5(F.col(text)))
    bare = lambda w: F.rtrim(w, F.lit(_CLOSING)).endswith(".")
    spots = F.filter(F.zip_with("_w", F.transform(_following(), lambda w, i: F.struct(w.alias("next"), i.alias("at"))), lambda w, n: F.struct(w.alias("own"), n["next"].alias("next"), n["at"].alias("at"))), lambda x: x["next"].isNotNull() & bare(x["own"]))
    each = words.select("_d", F.explode(spots).alias("x")).select("_d", "x.at", "x.next", word_type(F.col("x.own")).alias("type"))
    short = each.join(abbreviations.select("type").distinct(), "type", "left_semi").select("_d", "at", F.when(core(F.col("next")).rlike(r"^\p{Lu}"), word_type(F.col("next"))).alias("type"))
    begun = short.join(starters.select("type").distinct(), "type", "left_anti")
    inside = begun.groupBy("_d").agg(F.collect_set("at").alias("_inside"))

    def end(own: Column, following: Column) -> Column:
        return F.when(following["next"].isNull(), True).otherwise(_may_end(own) & ~F.array_contains(F.coalesce("_inside", F.array().cast("array<int>")), following["at"]))

    numbered = F.transform(_following(), lambda w, i: F.struct(w.alias("next"), i.alias("at")))
    return _spans(words.join(inside, "_d", "left"), F.zip_with("_w", numbered, end), out).drop("_d", "_inside")
