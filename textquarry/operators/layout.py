"""Page layout: body font size, heading levels, blocks and sections from spans (page_number, block, spans)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def body_size(spans: DataFrame, key: str = "doc_id", size: str = "size") -> DataFrame:
    """The commonest size to half a point, the first seen among equals (position); 12 where there is none."""
    half = F.bround(F.col(size) * 2) / 2
    n = spans.groupBy(key, half.alias("body")).agg(F.count(size).alias("n"), F.min("position").alias("at"))
    return n.groupBy(key).agg(F.coalesce(F.max_by(F.when(F.col("n") > 0, F.col("body")), F.struct("n", -F.col("at"))), F.lit(12.0)).alias("body"))


def heading_level(size: Column, body: Column, bold: Column) -> Column:
    r = size / body
    return F.when(r >= 1.6, 1).when(r >= 1.3, 2).when(r >= 1.1, 3).when(bold & (r >= 1.0), 3).otherwise(0)


def blocks(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each block: text, level (0: body text). Bold is bit 4 of flags; headings are shorter than 200 characters."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    own = spans.groupBy(key, "page_number", "block").agg(F.trim(text).alias("text"), F.max("size").alias("size"), F.bool_or(F.col("flags").bitwiseAND(16) != 0).alias("bold"))
    level = heading_level(F.col("size"), F.col("body"), F.col("bold"))
    return own.join(body_size(spans, key), key).filter("text <> ''").select(key, "page_number", "block", "text", F.when(F.length("text") < 200, level).otherwise(0).alias("level"))


def sections(blocks_: DataFrame, key: str = "doc_id", *order: str) -> DataFrame:
    """A heading starts a section; one without text is dropped. key, section_no, heading, level, text, page_start, page_end."""
    order = order or ("page_number", "block")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = blocks_.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct(*order, "text")))), lambda x: x["text"]), "\n\n")
    text_only = F.when(F.col("level") == 0, F.col("page_number"))
    out = n.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("level") > 0, F.col("text"))).alias("heading"),
        F.max("level").alias("level"),
        body.alias("text"),
        F.min("page_number").alias("page_start"),
        F.max(text_only).alias("page_end"),
    )
    return out.filter("text <> ''")


def page_sections(pages: DataFrame, blocks_: DataFrame, tables: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Sections over the pages of documents: key, section_no (from 0, without gaps), heading, level, text, page_start, page_end, has_table.

    pages: key, page_number, text and, if known, flat (a page read as an image, whose blocks do not count). A page without
    blocks is flat too: its text goes on with the section that is open. Tables (key, page_number, position, table) follow
    the blocks of their page and leave the section's end as it is. A section without text is dropped; a document without
    any section is one, with the text of all its pages. All parts of a document meet by one shuffle.
    """
    flat = F.coalesce("flat", F.lit(False)) if "flat" in pages.columns else F.lit(False)

    def part(df: DataFrame, kind: int, at: Column, level: Column, text: str, flat: Column = F.lit(False)) -> DataFrame:
        return df.select(key, F.col("page_number").cast("int").alias("page"), F.lit(kind).alias("kind"), at.cast("long").alias("at"), level.cast("int").alias("level"), F.col(text).alias("text"), flat.alias("flat"))

    rows = part(pages, 0, F.lit(0), F.lit(0), "text", flat).unionByName(part(blocks_, 1, F.col("block"), F.col("level"), "text"))
    if tables is not None:
        rows = rows.unionByName(part(tables, 2, F.col("position"), F.lit(0), "table"))
    page, own = Window.partitionBy(key, "page"), Window.partitionBy(key)
    told = rows.repartition(key).withColumn("flat", F.bool_or("flat").over(page) | ~F.bool_or(F.col("kind") == 1).over(page)).filter("kind = 0 OR NOT flat")
    no = F.sum((F.col("level") > 0).cast("int")).over(own.orderBy("page", "kind", "at").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.array(F.lit(-1).cast("long"))  # the section of all pages
    filed = told.withColumn("no", no).withColumn("no", F.explode(F.when(F.col("kind") > 0, F.array("no")).when(F.col("flat"), F.concat(whole, F.array("no"))).otherwise(whole)))
    body, heading = (F.col("level") == 0) & (T.strip("text") != ""), F.col("level") > 0
    parts = F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("page", "kind", "at", "text")))), lambda x: x["text"])
    found = filed.groupBy(key, "no").agg(
        F.max(F.when(heading, F.col("text"))).alias("heading"),
        F.max("level").alias("level"),
        parts.alias("parts"),
        F.coalesce(F.max(F.when(heading, F.col("page"))), F.lit(1)).alias("page_start"),
        F.max(F.when(body & (F.col("kind") < 2), F.col("page"))).alias("last"),
        F.max("page").alias("pages"),
    )
    text = T.strip(F.when(F.col("no") < 0, F.array_join("parts", "\n\n")).otherwise(F.array_join("parts", "\n")))
    kept = found.withColumn("text", text).filter("text <> ''").withColumn("most", F.max("no").over(own)).filter("no >= 0 OR most < 0")
    end = F.when(F.col("no") < 0, F.col("pages")).otherwise(F.coalesce("last", "page_start"))
    table = (F.col("no") >= 0) & F.exists("parts", lambda x: x.contains("| --- |"))
    place = (F.row_number().over(own.orderBy("no")) - 1).cast("long")
    return kept.select(key, place.alias("section_no"), "heading", "level", "text", "page_start", end.alias("page_end"), table.alias("has_table"))


def title(blocks_: DataFrame, key: str = "doc_id") -> DataFrame:
    """The largest of the first five blocks of page 1 with 4 to 119 characters (needs size)."""
    first = blocks_.filter("page_number = 1 AND block < 5").filter(F.length("text").between(4, 119))
    return first.groupBy(key).agg(F.max_by("text", F.struct("size", -F.col("block"))).alias("title"))


def join_pages(pages: DataFrame, key: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """key, text: the pages that are not blank, in order, a blank line between them. A document's pages meet in one row."""
    own = pages.filter(T.strip(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_p"))
    return own.select(key, F.array_join(F.transform("_p", lambda x: x[text]), "\n\n").alias("text"))


def with_tables(pages: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each page's text with its tables (key, page_number, position, table) after it."""
    held = tables.groupBy(key, "page_number").agg(F.array_sort(F.collect_list(F.struct("position", "table"))).alias("_t"))
    more = F.coalesce(F.transform("_t", lambda x: x["table"]), F.array().cast("array<string>"))
    return pages.join(held, [key, "page_number"], "left").withColumn("text", F.array_join(F.concat(F.array("text"), more), "\n\n")).drop("_t")


def real_tables(rows: Column) -> Column:
    """Whether rows make a table: two with some cell filled, and a first one of two cells or more."""
    filled = F.filter(rows, lambda r: F.exists(r, lambda x: F.coalesce(T.strip(x) != "", F.lit(False))))
    return (F.size(filled) >= 2) & (F.size(F.try_element_at(filled, F.lit(1))) >= 2)
