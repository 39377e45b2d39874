"""Sections over pages, worked out by hand; strict cleaning and tables."""

from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import layout

PAGES, BLOCKS, TABLES = "doc_id string, page_number int, text string, flat boolean", "doc_id string, page_number int, block int, level int, text string", "doc_id string, page_number int, position int, table string"
GRID = "| a | b |\n| --- | --- |\n| 1 | 2 |"


def build(spark, pages, blocks, tables=()):
    made = [spark.createDataFrame(list(rows), schema) for rows, schema in ((pages, PAGES), (blocks, BLOCKS), (tables, TABLES))]
    out = layout.page_sections(*made).orderBy("doc_id", "section_no").collect()
    return [tuple(r) for r in out]


def test_pages_without_blocks_and_images_go_on_with_the_open_section(spark):
    pages = [("d", 1, "T\nbody", None), ("d", 2, "scanned words", None), ("d", 3, "as an image", True), ("d", 4, "", None), ("d", 5, "U\nlast", False)]
    blocks = [("d", 1, 0, 1, "T"), ("d", 1, 1, 0, "body"), ("d", 3, 0, 1, "not seen"), ("d", 5, 0, 2, "U"), ("d", 5, 1, 0, "last")]
    assert build(spark, pages, blocks) == [("d", 0, "T", 1, "body\nscanned words\nas an image", 1, 3, False), ("d", 1, "U", 2, "last", 5, 5, False)]


def test_numbers_have_no_gaps_and_sections_without_text_go(spark):
    blocks = [("d", 1, i, level, text) for i, (level, text) in enumerate([(0, "before"), (1, "Empty"), (1, "Full"), (0, " x "), (3, "End")])]
    assert build(spark, [("d", 1, "all", None)], blocks) == [("d", 0, None, 0, "before", 1, 1, False), ("d", 1, "Full", 1, "x", 1, 1, False)]


def test_tables_follow_their_page_and_leave_the_end(spark):
    pages = [("d", 1, "p", None), ("d", 2, "q", None), ("d", 3, "r", None)]
    blocks = [("d", 1, 0, 1, "H"), ("d", 1, 1, 0, "p"), ("d", 2, 0, 1, "I")]
    tables = [("d", 1, 1, "second"), ("d", 1, 0, GRID), ("d", 2, 0, GRID), ("d", 3, 0, "on a page without blocks")]
    assert build(spark, pages, blocks, tables) == [("d", 0, "H", 1, f"p\n{GRID}\nsecond", 1, 1, True), ("d", 1, "I", 1, f"{GRID}\nr", 2, 3, True)]
    alone = build(spark, pages[:2], blocks[:1] + blocks[2:], tables[2:3])
    assert alone == [("d", 0, "I", 1, GRID, 2, 2, True)]


def test_without_any_section_all_pages_are_one(spark):
    pages = [("a", 1, "one", False), ("a", 2, " \n", False), ("a", 3, "three", False), ("b", 1, None, None), ("c", 1, "flat only", None)]
    blocks = [("a", i, 0, 1, "Head") for i in (1, 2, 3)]
    assert build(spark, pages, blocks) == [("a", 0, None, 0, "one\n\nthree", 1, 3, False), ("c", 0, None, 0, "flat only", 1, 1, False)]
    assert build(spark, [], []) == []


def test_one_shuffle(spark):
    made = [spark.createDataFrame(rows, schema) for rows, schema in (([("d", 1, "p", None)], PAGES), ([("d", 1, 0, 0, "p")], BLOCKS))]
    plan = layout.page_sections(*made)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1, plan


def test_strict_cleaning_and_tables(spark):
    row = spark.createDataFrame([("Hello\x00World\x1fEnd  \r\n \n\t\n\nx \x07\n",)], "t string").select(T.clean_text("t", strict=True), T.clean_text("t")).first()
    assert row[0] == "HelloWorldEnd\n\nx"
    assert row[1] == "Hello\x00World End \n \n \n\nx \x07"
    cells = F.array(F.array(F.lit("A|B"), F.lit(None).cast("string"), F.lit("C")), F.array(F.lit("only")))
    assert spark.range(1).select(T.table_to_markdown(cells, strict=True)).first()[0] == "| A\\|B |  | C |\n| --- | --- | --- |\n| only |  |  |"
