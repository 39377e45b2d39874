"""Queries of sections over pages, word-processor files and strict cleaning."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout
from ..sources import markup
from .prepare import _MD, _SPANS, _rows, _spans
from .registry import _t, query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _pages(spark, d) -> DataFrame:
    """The pages of forty lines that spans are on, some of them read as images."""
    lines = _t(spark, d, "documents", "doc_id", F.split("text", "\n").alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 40).cast("int")), lambda p: F.array_join(F.slice("lines", p * 40 + 1, 40), "\n"))
    page = (F.col("pos") + 1).alias("page_number")
    return lines.filter("lines IS NOT NULL").select("doc_id", F.posexplode(cut).alias("pos", "text")).select("doc_id", page, "text", ((F.col("doc_id") + page) % 5 == 0).alias("flat"))


@query(rf"""WITH {_SPANS}, b AS (SELECT * FROM bl WHERE doc_id % 11 <> 3 OR level > 0),
 pg AS (SELECT doc_id, (p - 1) // 40 + 1 AS page_number, string_agg(t[p], chr(10) ORDER BY p) AS text, (doc_id + (p - 1) // 40 + 1) % 5 = 0 AS flat
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)) GROUP BY ALL),
 laid AS (SELECT doc_id, page_number FROM pg WHERE NOT flat AND (doc_id, page_number) IN (SELECT (doc_id, page_number) FROM b)),
 el AS (SELECT doc_id, page_number, 0 AS kind, block AS pos, level, text FROM b JOIN laid USING (doc_id, page_number)
  UNION ALL SELECT doc_id, page_number, 0, 0, 0, text FROM pg ANTI JOIN laid USING (doc_id, page_number)
  UNION ALL SELECT conv_id, 1, 1, turn, 0, c.text FROM conversations c JOIN laid ON conv_id = doc_id AND page_number = 1),
 n AS (SELECT *, sum((level > 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_number, kind, pos) AS s, level = 0 AND {_STRIP.format('text')} <> '' AS body FROM el),
 sec AS (SELECT doc_id, s, max(text) FILTER (level > 0) AS heading, max(level)::INTEGER AS level, {_STRIP.format("string_agg(text, chr(10) ORDER BY page_number, kind, pos) FILTER (body)")} AS text,
   coalesce(max(page_number) FILTER (level > 0), 1) AS page_start, max(page_number) FILTER (body AND kind = 0) AS last, coalesce(bool_or(contains(text, '| --- |')) FILTER (body), false) AS has_table FROM n GROUP BY doc_id, s),
 kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS section_no, heading, level, text, page_start, coalesce(last, page_start) AS page_end, has_table FROM sec WHERE text <> ''),
 whole AS (SELECT doc_id, 0 AS section_no, NULL AS heading, 0 AS level, {_STRIP.format("string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (" + _STRIP.format('text') + " <> '')")} AS text, 1 AS page_start, max(page_number) AS page_end, false AS has_table
  FROM pg WHERE doc_id NOT IN (SELECT doc_id FROM kept) GROUP BY doc_id)
 SELECT doc_id, section_no::BIGINT AS section_no, heading, level::INTEGER AS level, md5(text) AS text_md5, page_start::INTEGER AS page_start, page_end::INTEGER AS page_end, has_table FROM (FROM kept UNION ALL FROM whole) WHERE text <> ''""")
def x12_page_sections(spark, d):
    """Sections over pages with images among them and tables; some documents have headings only, and are one section of all pages."""
    blocks = layout.blocks(_spans(spark, d)).filter("doc_id % 11 <> 3 OR level > 0")
    tables = _t(spark, d, "conversations", F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("turn").alias("position"), F.col("text").alias("table"))
    out = layout.page_sections(_pages(spark, d), blocks, tables)
    return out.select("doc_id", "section_no", "heading", "level", F.md5("text").alias("text_md5"), "page_start", "page_end", "has_table")


#: Words between white space of all kinds, some control characters among them.
_NOISY = r"replace(replace(replace(text, ', ', ',' || chr(7) || ' ' || chr(9)), '. ', '.  ' || chr(10) || ' ' || chr(10) || chr(13) || chr(10)), 'e ', 'e' || chr(127) || ' ')"


@query(rf"""WITH n AS (SELECT doc_id, {_NOISY} AS t FROM documents), c AS (SELECT doc_id, replace(replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM n)
 SELECT doc_id, md5({_STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS cleaned FROM c""")
def c1_strict_clean(spark, d):
    noisy = F.replace(F.replace(F.replace("text", F.lit(", "), F.lit(",\x07 \t")), F.lit(". "), F.lit(".  \n \n\r\n")), F.lit("e "), F.lit("e\x7f "))
    return _t(spark, d, "documents", "doc_id", noisy.alias("t")).select("doc_id", F.md5(T.clean_text("t", strict=True)).alias("cleaned"))


@query(rf"""WITH g AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: list_transform(string_split(x, ' ')[1:4], lambda c: CASE WHEN c LIKE '%,' THEN '' ELSE replace(replace(c, '.', '|'), '|', '\|') END)) AS r FROM documents),
 w AS (SELECT *, len(r[1]) AS w FROM g) SELECT doc_id, md5({_MD}) AS markdown_md5 FROM w""")
def c15_strict_table(spark, d):
    """Tables whose cells hold bars or nothing at all."""
    cell = lambda c: F.when(~c.endswith(","), F.replace(c, F.lit("."), F.lit("|")))
    rows = _rows(spark, d).withColumn("rows", F.transform("rows", lambda r: F.transform(r, cell)))
    return rows.select("doc_id", F.md5(T.table_to_markdown(F.col("rows"), strict=True)).alias("markdown_md5"))


def _word_files(spark, d) -> DataFrame:
    """The documents as word-processor files: a line is a paragraph, each sixth one a heading; some files are broken."""
    words = F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    level = F.floor(F.col("pos") / 6) % 3 + 1
    style = F.when(F.col("pos") % 6 == 0, F.concat(F.lit('<w:pPr><w:pStyle w:val="Heading'), level.cast("string"), F.lit('"/></w:pPr>'))).otherwise("")

    def zipped(xml: pd.Series) -> pd.Series:
        def one(body: str) -> bytes:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("word/document.xml", body)
            return held.getvalue()

        return xml.map(one)

    docs = _t(spark, d, "documents", "doc_id", F.split(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), "\n").alias("lines"))
    lines = docs.filter("lines IS NOT NULL").select("doc_id", F.posexplode("lines").alias("pos", "line"))
    para = F.concat(F.lit("<w:p>"), style, F.lit('<w:r><w:t xml:space="preserve">'), words, F.lit("</w:t></w:r></w:p>"))
    bodies = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", para.alias("p")))).alias("ps"))
    name = markup.WORD_NS.strip("{}")
    xml = F.concat(F.lit(f'<w:document xmlns:w="{name}"><w:body>'), F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("</w:body></w:document>"))
    whole = F.pandas_udf(zipped, "binary")(xml)
    return bodies.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.when(F.col("doc_id") % 13 == 5, F.encode(F.lit("no archive"), "UTF-8")).otherwise(whole).alias("content"))


@query(rf"""WITH l AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(10)) AS t FROM documents)),
 c AS (SELECT '/in/' || doc_id || '.docx' AS path, doc_id % 13 = 5 AS broken, p, {_STRIP.format(r"regexp_replace(t[p], '[ \t\f\v]+', ' ', 'g')")} AS part FROM l),
 n AS (SELECT *, CASE WHEN (p - 1) % 6 = 0 AND part <> '' THEN (p - 1) // 6 % 3 + 1 END AS level, sum(CASE WHEN (p - 1) % 6 = 0 AND part <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY p) AS s FROM c WHERE NOT broken),
 g AS (SELECT path, s, max(part) FILTER (level IS NOT NULL) AS heading, coalesce(max(level), 0)::INTEGER AS level, string_agg(part, chr(10) || chr(10) ORDER BY p) FILTER (level IS NULL AND part <> '') AS text FROM n GROUP BY path, s)
 SELECT path, (row_number() OVER (PARTITION BY path ORDER BY s) - 1)::INTEGER AS section_no, heading, level, md5(text) AS text_md5, NULL::VARCHAR AS error FROM g WHERE text <> ''
 UNION ALL SELECT DISTINCT path, NULL, NULL, NULL, NULL, 'not readable: BadZipFile' FROM c WHERE broken""")
def x_docx_sections(spark, d):
    """Sections of word-processor files, and a row with an error for each file that is none."""
    sections, bad = markup.docx_sections(_word_files(spark, d))
    return sections.unionByName(bad, allowMissingColumns=True).select("path", "section_no", "heading", "level", F.md5("text").alias("text_md5"), "error")
