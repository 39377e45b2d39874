"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import language_id, line_dedup, mixing, near_copies, packing
from textquarry.llm.common import forget, free_name, row_digest, settled

#: A language verdict with a lower score is no verdict, and the document goes.
LEAST_SCORE = 0.5


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*like.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a missing label is filled in.

    Null, empty and letterless texts have no language and go; repeated rows share their verdict; an empty table gives an
    empty table; ids are read only to choose the rows that are learned from (null: learned from); further columns stay,
    but lang_pred and score would be replaced and are dropped.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    scored = language_id.predict(docs, model)
    kept = scored.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines. Copies of a text count once: else a text that is copied often would go in all its copies.

    All rows stay, null and repeated ids too; a null text stays null; a text all of whose lines go becomes empty; an empty
    table gives an empty table.
    """
    return _columns(line_dedup.drop_lines(docs, once=True), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest id.

    Rows are told apart by all their columns, so different rows with one id, or without an id, are different documents; of
    rows alike in all columns one stays; a row without an id stays only where no row of its group has one; null and blank
    texts are copies of each other; an empty table gives an empty table.
    """
    found = near_copies.near_copies(docs)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    row = free_name(docs, "row")[0]
    rows = found.groupBy("component").agg(least).select(F.col("least.row").alias(row))
    told = docs.withColumn(row, row_digest(docs))
    return told.join(rows, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole; the last one taken of a source may pass its target by less than its own size.

    Rows are told apart by all their columns; rows alike in all columns share what the mix takes of them; a document
    without words is never taken; a null source is a source; an empty table gives an empty table.
    """
    row, copies, each = free_name(docs, "row", "copies", "copy")
    told = docs.withColumn(row, row_digest(docs))
    takes = mixing.mixed_documents(told, row).filter("taken > 0")
    takes = takes.groupBy(row).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(copies))
    joined = told.dropDuplicates([row]).join(takes, row)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(each)).drop(each)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its closing id; an empty table gives an empty table."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify), ("line_dedup", drop_boilerplate), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The first stage learns a model; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
