"""From ranked chunks to a prompt's context, and from an answer's markers to citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NO_SOURCES = "No relevant sources found."


def dedup(found: DataFrame, query: str = "query_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The first by rank of those of a document whose first 120 characters agree."""
    w = Window.partitionBy(query, doc, T.strip(F.substring(text, 1, 120))).orderBy("rank")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def within_budget(found: DataFrame, budget: int = 8000, overhead: int = 50, query: str = "query_id", text: str = "text") -> DataFrame:
    """The longest prefix by rank whose tokens, and an overhead for each, stay within budget."""
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("running", F.sum(T.token_count(text) + overhead).over(w)).filter(F.col("running") <= budget)


def source_block(i: Column, name: Column, page: Column, heading: Column, text: Column) -> Column:
    on_page = F.when(page > 0, F.concat(F.lit("p."), page.cast("string")))
    under = F.when(T.strip(heading) != "", F.concat(F.lit("§ "), heading))
    head = F.concat_ws(" | ", F.concat(F.lit("Source ["), i.cast("string"), F.lit("]")), name, on_page, under)
    return F.concat(head, F.lit("\n"), text, F.lit("\n"))


def assemble(found: DataFrame, budget: int = 8000, query: str = "query_id", name: str = "filename", page: Column | None = None, heading: Column | None = None) -> DataFrame:
    """One row for each query: context, total_tokens, n_chunks, truncated. Ranked lists are at most top-k long."""
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    told = dedup(found).withColumn("_in", F.sum(T.token_count("text") + 50).over(w) <= budget).withColumn("_i", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
    block = source_block(F.col("_i"), F.col(name), page if page is not None else F.lit(0), heading if heading is not None else F.lit(""), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("_i", block.alias("b")))))
    out = told.groupBy(query).agg(blocks.alias("_b"), F.count_if("_in").alias("n_chunks"), F.count(F.lit(1)).alias("_all"))
    joined = F.when(F.size("_b") > 0, F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).otherwise(NO_SOURCES)
    return out.withColumn("context", joined).select(query, "context", T.token_count("context").alias("total_tokens"), "n_chunks", (F.col("n_chunks") < F.col("_all")).alias("truncated"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("<sources>\n"), context, F.lit("\n</sources>\n\nQuestion: "), question)


def excerpt(text: Column, n: int, stripped: bool = False) -> Column:
    cut = F.substring(text, 1, n)
    return F.concat(T.strip(cut) if stripped else cut, F.when(F.length(text) > n, "…").otherwise(""))


def citations(answers: DataFrame, context: DataFrame, answer: str = "answer", query: str = "query_id", chars: int = 300, verified: bool = False) -> DataFrame:
    """A row for each distinct [n] of an answer that names a chunk (rank) of its context; verified adds the support score."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int")))
    cited = answers.select(query, F.col(answer).alias("_answer"), F.explode(marks).alias("rank"))
    out = cited.join(context, [query, "rank"])
    more = [T.support(first_claim("_answer", F.col("rank")), F.col("text")).alias("support")] if verified else []
    return out.select(query, "rank", "doc_id", excerpt(F.col("text"), chars, verified).alias("excerpt"), *more)


def first_claim(answer: str, n: Column) -> Column:
    """The first sentence that holds [n]."""
    return F.call_function("regexp_extract", F.col(answer), F.concat(F.lit(r"[^.!?]*\["), n.cast("string"), F.lit(r"\][^.!?]*[.!?]?")), F.lit(0))


def bibliography(cited: DataFrame, query: str = "query_id", page: str | None = None) -> DataFrame:
    """Distinct documents (and pages) in order of first citation, renumbered from 1."""
    keys = [query, "doc_id", *([page] if page else [])]
    first = cited.groupBy(*keys).agg(F.min("rank").alias("_first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(query).orderBy("_first"))).drop("_first")
