"""Queries of sources, cleaning steps, tables, layout and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, chunk, layout, search
from ..sources import files, markup, points
from .registry import _FIXED, _IS_PAGE, _LIG, _LINES, _RAW, _TEXT_SECTIONS, _TOKENS, _WORDS, _t, own_repeated_lines, query, repeated_lines


def _files(spark, d):
    """The documents as if they were files of several kinds, one of them unknown."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("TXT", "md", "log", "xyz")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit("_no-"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    docs = _t(spark, d, "documents", "doc_id", "source", "text")
    return files.dispatched(docs.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("length"), "text"))


_FILES = "f AS (SELECT doc_id, '/in/' || source || '_no-' || doc_id || '.' || ['TXT', 'md', 'log', 'xyz'][doc_id % 4 + 1] AS path, source || '_no-' || doc_id AS stem, lower(['TXT', 'md', 'log', 'xyz'][doc_id % 4 + 1]) AS suffix, strlen(text) AS length, text FROM documents)"


@query(f"WITH {_FILES} SELECT doc_id, suffix, CASE suffix WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'log' THEN 'text' END AS parser FROM f")
def s1_s2_dispatch(spark, d):
    return _files(spark, d).select("doc_id", "suffix", "parser")


@query(f"WITH {_FILES} SELECT suffix, count(*) AS n FROM f WHERE suffix = 'xyz' GROUP BY suffix")
def s3_unreadable_files(spark, d):
    bad = files.parse_files(_files(spark, d)).filter("error IS NOT NULL")
    return bad.groupBy(F.regexp_extract("error", r"\.(\w+)$", 1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


#: Headings of Markdown files are lines with marks (there are no fences in these texts), those of other files as in plain text.
_FILE_SECTIONS = _TEXT_SECTIONS.replace("doc_id", "path").replace("FROM documents", "FROM f WHERE suffix <> 'xyz'").replace("CASE WHEN s = ''", "CASE WHEN path LIKE '%.md' THEN CASE WHEN regexp_matches(line, '^#{1,6}\\s+') THEN length(regexp_extract(line, '^#+')) END WHEN s = ''")
_FILE_SECTIONS = _FILE_SECTIONS.replace("regexp_matches(s, '^[=-]+$') AND coalesce(lag", "path NOT LIKE '%.md' AND regexp_matches(s, '^[=-]+$') AND coalesce(lag")
_FILE_SECTIONS = _FILE_SECTIONS.replace("max(CASE WHEN level = 3", "max(CASE WHEN level IS NOT NULL AND path LIKE '%.md' THEN regexp_replace(regexp_replace(line, '^#{1,6}\\s+', ''), '\\s*#*\\s*$', '') WHEN level = 3")


@query(f"""WITH {_FILES}, {_FILE_SECTIONS} SELECT path, (row_number() OVER (PARTITION BY path ORDER BY sec) - 1)::INTEGER AS section_no, heading, level, text, false AS has_table, NULL::VARCHAR AS error FROM k WHERE text <> ''
 UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, 'no parser for .xyz' FROM f WHERE suffix = 'xyz'""")
def s3_s6_parsed_files(spark, d):
    return files.parse_files(_files(spark, d))


@query(rf"""WITH {_FILES}, c AS (SELECT path, stem, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM f WHERE suffix <> 'xyz')
 SELECT path, array_to_string(list_transform(string_split(translate(stem, '_-', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, md5(text) AS text_md5, len({_WORDS})::BIGINT AS word_count FROM c""")
def s5_text_documents(spark, d):
    return files.text_documents(_files(spark, d)).select("path", "title", F.md5("raw_text").alias("text_md5"), "word_count")


@query(f"WITH {_FILES} SELECT doc_id, suffix IN ('txt', 'md') AND length <= 52428800 AS admitted FROM f")
def s11_admission(spark, d):
    return files.admitted(_files(spark, d)).select("doc_id", "admitted")


_UUID5 = r"""(lambda_h[1:8] || '-' || lambda_h[9:12] || '-5' || lambda_h[14:16] || '-' || translate(lambda_h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || lambda_h[18:20] || '-' || lambda_h[21:32])""".replace("lambda_h", "h")


@query(rf"WITH {_FIXED} SELECT {_UUID5} AS point_id, chunk_index, 'unknown' AS doc_type FROM (SELECT sha1('\x6b\xa7\xb8\x10\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode(chunk_id)) AS h, chunk_index FROM chunks)")
def s13_s19_points(spark, d):
    """Point ids of all chunks, and what their payloads read back as."""
    held = points.to_points(chunk.fixed_chunks(_t(spark, d, "documents")).select("chunk_id", "chunk_index", F.lit(None).cast("array<float>").alias("embedding")))
    return points.from_points(held).select("point_id", "chunk_index", "doc_type")


@query("SELECT count(*) AS points, min(len(embedding))::INTEGER AS least_dims, max(len(embedding))::INTEGER AS most_dims, count(*) - count(embedding) AS without_vector FROM embeddings")
def s17_collection_stats(spark, d):
    return points.stats(_t(spark, d, "embeddings"), "embedding")


@query(f"WITH {_FIXED}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT doc_id, CASE WHEN n > 0 THEN 'indexed' ELSE 'failed' END AS status, coalesce(n, 0) AS chunk_count, md5(substr(text, 1, 50000)) AS start_md5 FROM documents LEFT JOIN n USING (doc_id)")
def s18_index_records(spark, d):
    docs = _t(spark, d, "documents")
    return files.index_records(docs, chunk.fixed_chunks(docs)).select("doc_id", "status", "chunk_count", F.md5("raw_text").alias("start_md5"))


# --- cleaning, one step each, on texts that hold what the step removes


def _step(spark, d, planted, f):
    return _t(spark, d, "documents", "doc_id", planted.alias("text")).select("doc_id", F.md5(f("text")).alias("cleaned"))


@query(f"SELECT doc_id, md5({_RAW}) AS cleaned FROM (SELECT doc_id, replace(replace(text, 'é', 'e' || chr(769)), ' a', chr(7) || chr(13) || chr(10) || 'a') AS text FROM documents)")
def c2_fix_encoding(spark, d):
    return _step(spark, d, F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit(" a"), F.lit("\x07\r\na")), T.fix_encoding)


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, ' a', ' (cid:97)'), '\(cid:\d+\)|\x{FFFD}', '', 'g')) AS cleaned FROM documents")
def c3_drop_cid(spark, d):
    return _step(spark, d, F.replace("text", F.lit(" a"), F.lit(" (cid:97)")), T.drop_cid)


@query(f"SELECT doc_id, md5({_LIG}) AS cleaned FROM (SELECT doc_id, replace(replace(text, 'fi', 'ﬁ'), 'oe', 'œ') AS text FROM documents)")
def c4_ligatures(spark, d):
    return _step(spark, d, F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("oe"), F.lit("œ")), T.fix_ligatures)


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, 'e ', 'e-' || chr(10) || ' '), '([\p{L}\p{N}\p{M}_])-\n\s*([a-z])', '\1\2', 'g')) AS cleaned FROM documents")
def c5_join_hyphens(spark, d):
    return _step(spark, d, F.replace("text", F.lit("e "), F.lit("e-\n ")), T.join_hyphens)


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, ', ', ',   '), '. ', '. ' || chr(9) || repeat(chr(10), 4)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '([^\n]|^) {2,}', '\1 ', 'g')) AS cleaned FROM documents""")
def c6_tidy_spaces(spark, d):
    return _step(spark, d, F.replace(F.replace("text", F.lit(", "), F.lit(",   ")), F.lit(". "), F.lit(". \t\n\n\n\n")), T.tidy_spaces)


@query(rf"""WITH l AS (SELECT source, list_filter({_LINES}, lambda x: x <> '') AS l FROM documents),
 e AS (SELECT source, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):len(l)])) AS line FROM l),
 r AS (SELECT source, line FROM e WHERE length(line) > 4 AND NOT {_IS_PAGE.format('line')} GROUP BY ALL HAVING count(*) >= 3),
 g AS (SELECT source, list(line) AS gone FROM r GROUP BY source)
 SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda y: NOT coalesce(list_contains(gone, regexp_replace(y, '^\s+|\s+$', '', 'g')), false)), chr(10))) AS cleaned FROM documents LEFT JOIN g USING (source)""")
def c10_drop_learned_lines(spark, d):
    docs = _t(spark, d, "documents", "doc_id", "source", "text")
    told = own_repeated_lines(docs, "doc_id", "source", repeated_lines(docs, "source"), "text")
    return told.select("doc_id", F.md5(T.drop_lines("text", F.col("gone"))).alias("cleaned"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' GROUP BY conv_id")
def c13_join_pages(spark, d):
    return layout.join_pages(_t(spark, d, "conversations", "conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", F.md5("text").alias("joined"))


@query(r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 30 AS scanned FROM documents")
def c14_scanned(spark, d):
    return _t(spark, d, "documents", "doc_id", "text").select("doc_id", T.is_scanned("text").alias("scanned"))


_ROWS = "r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')[1:4]) AS r FROM documents)"


def _rows(spark, d):
    cells = F.transform(F.split("text", "\n"), lambda x: F.slice(F.split(x, " "), 1, 4))
    return _t(spark, d, "documents", "doc_id", cells.alias("rows"))


_MD = "array_to_string(list_concat(['| ' || array_to_string(list_resize(r[1], w, ''), ' | ') || ' |', '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'], list_transform(r[2:], lambda x: '| ' || array_to_string(list_resize(x, w, ''), ' | ') || ' |')), chr(10))"


@query(f"WITH {_ROWS}, w AS (SELECT *, len(r[1]) AS w FROM r) SELECT doc_id, md5({_MD}) AS markdown_md5 FROM w")
def c15_table_markdown(spark, d):
    return _rows(spark, d).select("doc_id", F.md5(T.table_to_markdown(F.col("rows"))).alias("markdown_md5"))


@query(rf"WITH {_ROWS}, w AS (SELECT *, list_max(list_transform(r, lambda x: len(x))) AS w FROM r) SELECT doc_id, md5({_MD}) AS markdown_md5 FROM w")
def c16_page_table_markdown(spark, d):
    return _rows(spark, d).select("doc_id", F.md5(T.page_table_to_markdown(F.col("rows"))).alias("markdown_md5"))


@query(r"WITH " + _ROWS + r" SELECT doc_id, len(list_filter(r, lambda x: len(list_filter(x, lambda c: c <> '')) > 0)) >= 2 AND len(list_filter(r, lambda x: len(list_filter(x, lambda c: c <> '')) > 0)[1]) >= 2 AS is_table FROM r")
def s9_real_tables(spark, d):
    return _rows(spark, d).select("doc_id", layout.real_tables(F.col("rows")).alias("is_table"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN source END AS source FROM documents")
def c17_clean_meta(spark, d):
    given = F.when(F.col("doc_id") % 3 == 0, "None").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), "source", F.lit(" "))).otherwise("  ")
    return _t(spark, d, "documents", "doc_id", given.alias("s")).select("doc_id", T.clean_meta("s").alias("source"))


# --- layout: a document's lines as spans, short ones in larger type


def _spans(spark, d):
    line = _t(spark, d, "documents", "doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text")).filter("trim(text) <> ''")
    size = F.when(F.col("position") == 0, 24.0).when(F.length("text") < 30, 16.2).otherwise(F.when(F.col("position") % 3 == 0, 11.0).otherwise(12.1))
    return line.select("doc_id", "position", "text", F.floor(F.col("position") / 40).cast("int").alias("page") + 1, (F.col("position") % 40).alias("block"), size.alias("size"), F.when(F.col("text").endswith(":"), 16).otherwise(0).alias("flags")).toDF("doc_id", "position", "text", "page_number", "block", "size", "flags")


_SPANS = """sp AS (SELECT doc_id, p - 1 AS position, t[p] AS text, (p - 1) // 40 + 1 AS page_number, (p - 1) % 40 AS block,
 CASE WHEN p = 1 THEN 24.0 WHEN length(t[p]) < 30 THEN 16.2 WHEN (p - 1) % 3 = 0 THEN 11.0 ELSE 12.1 END::DOUBLE AS size, t[p] LIKE '%:' AS bold
 FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)) WHERE trim(t[p]) <> ''),
 bs AS (SELECT doc_id, body FROM (SELECT doc_id, round_even(size * 2, 0) / 2 AS body, count(*) AS n, min(position) AS pos FROM sp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1),
 bl AS (SELECT doc_id, page_number, block, size, trim(text) AS text, CASE WHEN length(trim(text)) >= 200 THEN 0 WHEN size / body >= 1.6 THEN 1 WHEN size / body >= 1.3 THEN 2 WHEN size / body >= 1.1 THEN 3 WHEN bold AND size / body >= 1 THEN 3 ELSE 0 END AS level FROM sp JOIN bs USING (doc_id))"""


@query(f"WITH {_SPANS} SELECT doc_id, body::DOUBLE AS body FROM bs")
def x9_body_size(spark, d):
    return layout.body_size(_spans(spark, d))


@query(f"WITH {_SPANS} SELECT doc_id, page_number::INTEGER AS page_number, block::INTEGER AS block, level::INTEGER AS level FROM bl")
def x10_x11_blocks(spark, d):
    return layout.blocks(_spans(spark, d)).select("doc_id", "page_number", "block", "level")


@query(rf"""WITH {_SPANS}, n AS (SELECT *, sum((level > 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_number, block) AS s FROM bl)
 SELECT doc_id, s::BIGINT AS section_no, max(text) FILTER (level > 0) AS heading, max(level)::INTEGER AS level, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_number, block) FILTER (level = 0)) AS text_md5, min(page_number)::INTEGER AS page_start, (max(page_number) FILTER (level = 0))::INTEGER AS page_end
 FROM n GROUP BY doc_id, s HAVING count(*) FILTER (level = 0) > 0""")
def x1_x12_w4_sections(spark, d):
    out = layout.sections(layout.blocks(_spans(spark, d)))
    return out.select("doc_id", "section_no", "heading", "level", F.md5("text").alias("text_md5"), "page_start", "page_end")


@query(f"WITH {_SPANS} SELECT doc_id, text AS title FROM bl WHERE page_number = 1 AND block < 5 AND length(text) BETWEEN 4 AND 119 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, block) = 1")
def x13_title(spark, d):
    own = _spans(spark, d)
    sized = layout.blocks(own).join(own.groupBy("doc_id", "page_number", "block").agg(F.max("size").alias("size")), ["doc_id", "page_number", "block"])
    return layout.title(sized)


@query("SELECT doc_id, md5(array_to_string(list_concat([d.text], coalesce(b.t, [])), chr(10) || chr(10))) AS text_md5 FROM documents d LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) b ON d.doc_id = b.conv_id")
def x14_j7_pages_with_tables(spark, d):
    """Each document as a page, the turns of the conversation with its number as tables of it."""
    pages = _t(spark, d, "documents", "doc_id", F.lit(1).alias("page_number"), "text")
    tables = _t(spark, d, "conversations", F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), F.col("turn").alias("position"), F.col("text").alias("table"))
    return layout.with_tables(pages, tables).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) <> '' AS has_title FROM pages")
def x2_page_has_title(spark, d):
    return markup.html_metadata(_t(spark, d, "pages", "page_id", "html")).select("page_id", (F.coalesce("title", F.lit("")) != "").alias("has_title"))


# --- chunks and vectors


@query(f"WITH {_FIXED} SELECT chunk_id, lang, source, length(text)::BIGINT AS char_count, {_TOKENS} AS token_count FROM chunks")
def k15_k16_inherited(spark, d):
    """Chunks with what they take over from their document."""
    return chunk.fixed_chunks(_t(spark, d, "documents"), keep=("lang", "source")).select("chunk_id", "lang", "source", "char_count", "token_count")


@query("SELECT doc_id, 'emb:hashed:64:' || md5(text) AS key, length(substr(text, 1, 32764))::BIGINT AS n FROM documents")
def e2_e5_cache_keys(spark, d):
    return _t(spark, d, "documents", "doc_id", F.concat(F.lit("emb:hashed:64:"), F.md5("text")).alias("key"), F.length(F.substring("text", 1, 32764)).cast("long").alias("n"))


@query("SELECT doc_id, d.lang, len(e.embedding)::INTEGER AS dims FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def j6_attach_vectors(spark, d):
    return _t(spark, d, "documents", "doc_id", "lang").join(_t(spark, d, "embeddings", F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims")), "doc_id")


@query("WITH k AS (SELECT md5(text) AS key, min(doc_id) % 2 = 0 AS hit FROM documents GROUP BY text) SELECT d.doc_id, k.hit FROM documents d JOIN k ON md5(d.text) = k.key")
def u1_hits_and_fresh(spark, d):
    """Rows whose text the cache has, and those whose vector was made anew, in one table."""
    docs = _t(spark, d, "documents", "doc_id", "text")
    cache = docs.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("low")).filter("low % 2 = 0").select("key")
    hits, fresh = catalog.cache_split(docs, cache)
    made = docs.withColumn("key", F.md5("text")).join(fresh.select("key"), "key")
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(made.select("doc_id", F.lit(False).alias("hit")))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND doc_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def f2_f4_request_filters(spark, d):
    docs = _t(spark, d, "documents", "doc_id", F.col("lang").alias("doc_type"), "source")
    asked = {"file_type": "fr", "document_ids": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], "source": "", "tags": []}
    return search.metadata_filter(docs, search.request_filters(asked)).withColumnRenamed("doc_type", "lang")
