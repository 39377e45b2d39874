"""Every query by name, with its SQL where SQL can express it. Names start with the identifiers of the operator inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import catalog, chunk, context, search
from ..sources import markup
from ..storage import join_few, written
from ..streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict = {}

QUESTION = "  What  do the\tsources   say? "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The questions of the retrieval queries: every row whose id is divisible by 100, with its vector and the three longest
    terms of its own text, which are its rarest as a rule. Written, as all searches read it more than once."""
    vectors = _t(spark, d, "embeddings", F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qv")).filter("query_id % 100 = 0")
    docs = _t(spark, d, "documents", F.col("doc_id").alias("query_id"), "text").filter("query_id % 100 = 0")
    by_size = F.array_sort(F.transform(F.array_distinct(T.terms("text")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    docs = docs.select("query_id", F.transform(F.slice(by_size, 1, 3), lambda x: x["t"]).alias("ts"))
    return written(vectors.join(docs, "query_id", "full_outer").select("query_id", "qv", "ts"))


_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"
_ASKED_SQL = f"""asked AS (SELECT coalesce(e.query_id, t.query_id) AS query_id, qv, ts FROM (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0) e
 FULL JOIN (SELECT doc_id AS query_id, list_transform(list_sort(list_transform(list_distinct({_TERMS}), lambda x: {{'n': -length(x), 't': x}}))[1:3], lambda y: y.t) AS ts FROM documents WHERE doc_id % 100 = 0) t USING (query_id))"""
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_TOKENS = "greatest(1, round(n_words / 0.75))::BIGINT"
_LIG = "text"
for _k, _v in T.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_k}', '{_v}')"
_RAW = rf"""regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\r\n?', chr(10), 'g')"""
_PAGE_RAW = _LIG.replace("text", rf"regexp_replace({_RAW}, '\(cid:\d+\)|\x{{FFFD}}', '', 'g')", 1)
_PAGE_RAW = rf"regexp_replace({_PAGE_RAW}, '([\p{{L}}\p{{N}}\p{{M}}_])-\n\s*([a-z])', '\1\2', 'g')"


def _tidy_sql(text: str) -> str:
    text = rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '([^\n]|^) {{2,}}', '\1 ', 'g')"
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


_TIDY, _CLEAN_RAW = _tidy_sql("text"), _tidy_sql(_PAGE_RAW)
_FIXED = rf"""w AS (SELECT doc_id, source, lang, {_WORDS} AS w FROM documents),
 c AS (SELECT doc_id, source, lang, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 384) / 336.0))::BIGINT)) AS chunk_index FROM w WHERE len(w) > 0),
 chunks AS (SELECT doc_id, source, lang, chunk_index, array_to_string(w[chunk_index * 336 + 1 : chunk_index * 336 + 384], ' ') AS text, len(w[chunk_index * 336 + 1 : chunk_index * 336 + 384]) AS n_words, md5(doc_id || '|fixed|' || chunk_index) AS chunk_id FROM c)"""
_DENSE = f"""{_ASKED_SQL},
 ds AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, asked WHERE qv IS NOT NULL)"""
_KEYWORD = f"""tk AS (SELECT doc_id, list_distinct({_TERMS}) AS t FROM documents),
 ks AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM tk, asked WHERE len(ts) > 0 AND list_has_all(t, ts))"""


def _hybrid_sql(k: int) -> str:
    return f"""{_DENSE}, {_KEYWORD},
 d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS dr FROM ds) WHERE dr <= {3 * k}),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS kr FROM ks) WHERE kr <= {3 * k}),
 f AS (SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.doc_id, k.doc_id) AS doc_id, dr, kr, coalesce(0.7::DOUBLE / (60 + dr), 0) + coalesce(0.3::DOUBLE / (60 + kr), 0) AS raw FROM d FULL JOIN k ON d.query_id = k.query_id AND d.doc_id = k.doc_id),
 hybrid AS (SELECT * FROM (SELECT query_id, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, dr NULLS LAST, kr NULLS LAST)::INTEGER AS rank FROM f) WHERE rank <= {k})"""


def _hybrid(spark, d, k=20):
    return search.hybrid_search(_t(spark, d, "embeddings", F.col("vec_id").alias("doc_id"), "embedding"), _t(spark, d, "documents", "doc_id", "text"), _asked(spark, d), k, "doc_id").drop("dr", "kr")


# --- text


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned FROM documents")
def c1_clean_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.clean_text("text")).alias("cleaned"))


@query(f"SELECT doc_id, md5({_CLEAN_RAW}) AS cleaned, length({_CLEAN_RAW})::BIGINT AS n FROM documents")
def c12_clean_raw(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean_raw("text").alias("c")).select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("n"))


_LINES = r"list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_IS_PAGE = r"(regexp_matches({0}, '^[-–—\s]*\d{{1,4}}[-–—\s]*$') OR regexp_matches({0}, '(?i)^page\s+\d+(\s+(of|/)\s+\d+)?$') OR regexp_matches({0}, '^\d+\s*/\s*\d+$'))"


@query(f"SELECT doc_id, len(list_filter({_LINES}, lambda x: {_IS_PAGE.format('x')}))::BIGINT AS page_number_lines, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda y: NOT {_IS_PAGE.format('trim(y)')}), chr(10))) AS kept FROM documents")
def c8_page_number_lines(spark, d):
    n = F.size(F.filter(T.lines("text"), lambda x: T.is_page_number(x))).cast("long")
    return _t(spark, d, "documents").select("doc_id", n.alias("page_number_lines"), F.md5(T.drop_page_numbers("text")).alias("kept"))


def repeated_lines(pages: DataFrame, doc: str, text: str = "text", least: int = 3) -> DataFrame:
    """doc, line, n: lines among the first and last three of a page that occur `least` times; occurrences, not pages, count."""
    own = F.filter(T.lines(text), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))
    ends = T._once(own, lambda l: F.concat(F.slice(l, 1, 3), F.slice(l, F.greatest(F.lit(1), F.size(l) - 2), F.lit(3))))
    line = pages.select(doc, F.explode(F.transform(ends, T.strip)).alias("line"))
    return line.filter((F.length("line") > 4) & ~T.is_page_number(F.col("line"), stripped=True)).groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


@query(f"""WITH l AS (SELECT source, list_filter({_LINES}, lambda x: x <> '') AS l FROM documents),
 e AS (SELECT source, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):len(l)])) AS line FROM l)
 SELECT source, line, count(*) AS n FROM e WHERE length(line) > 4 AND NOT {_IS_PAGE.format('line')} GROUP BY ALL HAVING count(*) >= 3""")
def c9_repeated_lines(spark, d):
    return repeated_lines(_t(spark, d, "documents", "source", "text"), "source")


def own_repeated_lines(pages: DataFrame, key: str, doc: str, learned: DataFrame, text: str) -> DataFrame:
    """pages with gone: those of their own stripped lines that their document's learned lines hold.

    Lines meet the learned ones where they are read, or by salt if these are many, so that a document with any share of the
    pages, and a line that all of them hold, spread over many tasks; a page gathers its own lines only. Pages with one key share them.
    """
    lines = pages.select(F.col(key).alias("_k"), F.col(doc).alias("_d"), F.explode(F.array_distinct(F.transform(T.lines(text), T.strip))).alias("line"))
    known = written(learned.select(F.col(doc).alias("_d"), "line"))
    hits = join_few(lines, known, ["_d", "line"], ["_k"], "left_semi").groupBy("_k", "_d").agg(F.collect_set("line").alias("gone"))
    held = pages.withColumnRenamed(key, "_k").withColumnRenamed(doc, "_d").join(hits, ["_k", "_d"], "left")
    return held.withColumnRenamed("_k", key).withColumnRenamed("_d", doc)


@query(f"""WITH p AS (SELECT doc_id, source, {_PAGE_RAW} AS text FROM documents),
 l AS (SELECT source, list_filter({_LINES}, lambda x: x <> '') AS l FROM documents),
 e AS (SELECT source, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):len(l)])) AS line FROM l),
 r AS (SELECT source, line FROM e WHERE length(line) > 4 AND NOT {_IS_PAGE.format('line')} GROUP BY ALL HAVING count(*) >= 3),
 g AS (SELECT source, list(line) AS gone FROM r GROUP BY source),
 k AS (SELECT doc_id, array_to_string(list_filter(list_filter(string_split(text, chr(10)), lambda y: NOT coalesce(list_contains(gone, regexp_replace(y, '^\\s+|\\s+$', '', 'g')), false)), lambda z: NOT {_IS_PAGE.format("regexp_replace(z, '^\\s+|\\s+$', '', 'g')")}), chr(10)) AS text FROM p LEFT JOIN g USING (source))
 SELECT doc_id, md5({_TIDY}) AS cleaned FROM k""")
def c11_clean_pages(spark, d):
    """Pages without what their document's learned lines and page numbers add."""
    docs = _t(spark, d, "documents", "doc_id", "source", "text")
    pages = written(docs.select("doc_id", "source", T.join_hyphens(T.fix_ligatures(T.drop_cid(T.fix_encoding("text")))).alias("page")))  # read twice
    told = own_repeated_lines(pages, "doc_id", "source", repeated_lines(docs, "source"), "page")
    return told.select("doc_id", F.md5(T.strip(T.tidy_spaces(T.drop_lines_and_numbers("page", F.col("gone"))))).alias("cleaned"))


@query(f"SELECT doc_id, n_words, {_TOKENS} AS tokens FROM (SELECT doc_id, len({_WORDS})::BIGINT AS n_words FROM documents)")
def c18_k1_word_and_token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.word_count("text").alias("n_words"), T.token_count("text").alias("tokens"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '([.!?])\s+([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
 SELECT doc_id, i AS position, md5(s[i]) AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def k11_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text"))).select("doc_id", (F.col("pos") + 1).cast("long").alias("position"), F.md5("col").alias("sentence"))


# --- chunks


def _recursive_sql(source: str, size: int = 512, overlap: int = 64) -> str:
    """CTEs for recursive chunks of a table with k and t: bodies(k, i, body, tail) and rc(k, chunk_index, text, n_words).

    (Every white space in the given texts is a separator, so what has none left is one word, and fits.)
    """
    words = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))"
    return rf"""sep AS (SELECT [chr(10) || chr(10), chr(10), '. ', '! ', '? ', '; ', ', ', ' '] AS seps),
 s AS (SELECT k, [0]::BIGINT[] AS path, t, 0::BIGINT AS lv FROM {source}
  UNION ALL SELECT k, list_append(path, i), p[i] || CASE WHEN i < len(p) THEN cut_at ELSE '' END, j
   FROM (SELECT k, path, p, cut_at, j, unnest(range(1, len(p) + 1)) AS i FROM (SELECT k, path, string_split(t, seps[j]) AS p, seps[j] AS cut_at, j
    FROM (SELECT s.*, seps, list_min(list_filter(range(lv + 1, 9), lambda x: contains(t, seps[x]))) AS j FROM s, sep WHERE {words} / 0.75 > {size}.5) WHERE j IS NOT NULL))),
 o AS (SELECT k, t, greatest(1, round({words} / 0.75))::BIGINT AS n, row_number() OVER (PARTITION BY k ORDER BY path) AS i FROM s WHERE {words} BETWEEN 1 AND {int(0.75 * size)}),
 m AS (SELECT k, i, t, 1::BIGINT AS c, n AS total FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, o.t, c + (total + o.n > {size})::BIGINT, CASE WHEN total + o.n > {size} THEN o.n ELSE total + o.n END FROM m JOIN o ON o.k = m.k AND o.i = m.i + 1),
 r_body AS (SELECT k, c, regexp_replace(string_agg(t, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM m GROUP BY k, c),
 bw AS (SELECT *, list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '') AS w FROM r_body),
 rt AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY c) - 1 AS chunk_index, coalesce(array_to_string(lag(w) OVER (PARTITION BY k ORDER BY c)[-{round(0.75 * overlap)}:], ' ') || ' ', '') || body AS text FROM bw),
 rc AS (SELECT k, chunk_index, text, {words.replace('(t,', '(text,')} AS n_words FROM rt)"""


@query(f"WITH {_FIXED} SELECT doc_id, chunk_index, chunk_id, md5(text) AS text_md5, {_TOKENS} AS token_count, length(text)::BIGINT AS char_count FROM chunks")
def k5_fixed_chunks(spark, d):
    return chunk.fixed_chunks(_t(spark, d, "documents")).select("doc_id", "chunk_index", "chunk_id", F.md5("text").alias("text_md5"), "token_count", "char_count")


_DOCS_T = "(SELECT doc_id AS k, text AS t FROM documents)"


@query(f"WITH RECURSIVE {_recursive_sql(_DOCS_T)} SELECT k AS doc_id, chunk_index, md5(k || '|recursive|' || chunk_index) AS chunk_id, text, {_TOKENS} AS token_count, length(text)::BIGINT AS char_count FROM rc")
def k6_recursive_chunks(spark, d):
    return chunk.recursive_chunks(_t(spark, d, "documents", "doc_id", "text")).select("doc_id", "chunk_index", "chunk_id", "text", "token_count", "char_count")


@query()
def k14_semantic_chunks(spark, d):
    return chunk.semantic_chunks(_t(spark, d, "documents", "doc_id", "text"), threshold=0.2).select("doc_id", "chunk_index", "chunk_id", "text", "token_count", "char_count")


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) < 3 AND source = 'src1' THEN 'fixed' WHEN length(text) > 200000 AND text NOT LIKE '%' || chr(10) || '%' THEN 'fixed' ELSE 'recursive' END AS strategy FROM documents")
def k17_router(spark, d):
    n = F.size(F.split("text", "\n"))
    return _t(spark, d, "documents").select("doc_id", chunk.strategy(F.when(F.col("source") == "src1", "pdf").otherwise("text"), F.when(n == 1, 0).otherwise(n), F.col("text")).alias("strategy"))


@query(f"WITH {_FIXED}, t AS (SELECT lang AS strategy, {_TOKENS} AS n FROM chunks) SELECT strategy, count(*) AS count, round_even(avg(n), 0)::BIGINT AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM t GROUP BY strategy")
def k19_chunk_summary(spark, d):
    return chunk.summary(chunk.fixed_chunks(_t(spark, d, "documents"), keep=("lang",)).withColumnRenamed("lang", "strategy"))


@query(f"""WITH RECURSIVE {_FIXED}, {_recursive_sql(_DOCS_T)}, both_ AS (SELECT 'fixed' AS strategy, {_TOKENS} AS n FROM chunks UNION ALL SELECT 'recursive', {_TOKENS} FROM rc)
 SELECT strategy, count(*) AS count, round_even(avg(n), 0)::BIGINT AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM both_ GROUP BY strategy""")
def k18_compare_strategies(spark, d):
    return chunk.compare(_t(spark, d, "documents", "doc_id", "text"))


# --- vectors and retrieval


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 5)) AS unit FROM embeddings")
def e4_l2_normalise(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.transform(V.l2_normalise("embedding"), lambda x: V.rounded(x, 5)).alias("unit"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], prev::DOUBLE[]), 6) AS similarity FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL")
def k12_w2_adjacent_cosine(spark, d):
    prev = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return _t(spark, d, "embeddings").withColumn("prev", prev).filter("prev IS NOT NULL").select("vec_id", V.rounded(V.cosine("embedding", "prev"), 6).alias("similarity"))


@query("SELECT md5(text) AS key, min(length(text))::BIGINT AS n FROM documents GROUP BY text HAVING min(doc_id) % 2 = 1")
def e1_j5_cache_misses(spark, d):
    """Texts that a cache of those with an even smallest id lacks, each once."""
    docs = _t(spark, d, "documents", "doc_id", "text")
    cache = docs.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("low")).filter("low % 2 = 0").select("key")
    return catalog.cache_split(docs.select("text"), cache)[1].select("key", F.length("text").cast("long").alias("n"))


@query(f"WITH {_DENSE} SELECT * FROM (SELECT query_id, doc_id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds) WHERE rank <= 20")
def r1_dense_search(spark, d):
    return search.dense_search(_t(spark, d, "embeddings"), _asked(spark, d), 20, "vec_id")


@query(f"WITH {_DENSE} SELECT * FROM (SELECT query_id, doc_id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds WHERE score >= 0.3) WHERE rank <= 20")
def f6_dense_threshold(spark, d):
    return search.dense_search(_t(spark, d, "embeddings"), _asked(spark, d), 20, "vec_id", least=0.3)


@query(f"WITH {_DENSE}, {_KEYWORD} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INTEGER AS rank FROM ks) WHERE rank <= 20")
def r2_keyword_search(spark, d):
    return search.keyword_search(_t(spark, d, "documents", "doc_id", "text"), _asked(spark, d), 20, "doc_id")


@query(f"WITH {_hybrid_sql(20)} SELECT * FROM hybrid")
def r4_hybrid_search(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {_hybrid_sql(20)} SELECT * FROM (SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hybrid) WHERE score >= 0.012")
def r11_f5_search_projection(spark, d):
    return _hybrid(spark, d).withColumn("score", F.round("score", 4)).filter("score >= 0.012")


@query(f"WITH {_hybrid_sql(20)} SELECT query_id, doc_id, length(text)::DOUBLE AS score, score AS original_score, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank)::INTEGER AS rank FROM hybrid JOIN documents USING (doc_id) QUALIFY rank <= 5".replace("QUALIFY rank <= 5", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, hybrid.rank) <= 5").replace("DESC, rank)::", "DESC, hybrid.rank)::"))
def r8_rerank(spark, d):
    """A scorer that is a column: here the text's length."""
    size = _t(spark, d, "documents", "doc_id", F.length("text").cast("double").alias("size"))
    found = join_few(size, written(_hybrid(spark, d)), ["doc_id"], ["doc_id"])
    return search.rerank(found, 5, F.col("size")).select("query_id", "doc_id", "score", "original_score", "rank")


@query(f"WITH {_DENSE} SELECT * FROM (SELECT query_id, doc_id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds WHERE doc_id <> query_id) WHERE rank <= 5")
def r12_more_like_this(spark, d):
    return search.more_like_this(_t(spark, d, "embeddings"), _asked(spark, d), 5, "vec_id")


_BM25 = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS t FROM documents),
 s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
 q AS (SELECT query_id, unnest(ts) AS term FROM asked),
 tf AS (SELECT query_id, doc_id, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf FROM t, q),
 df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tf WHERE tf > 0 GROUP BY term),
 b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6)::DOUBLE AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY ALL)"""


@query(f"WITH {_ASKED_SQL}, {_BM25} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b) WHERE rank <= 20")
def g1_bm25(spark, d):
    return search.bm25(_t(spark, d, "documents", "doc_id", "text"), _asked(spark, d))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src3', 'src5')")
def f1_metadata_filter(spark, d):
    return search.metadata_filter(_t(spark, d, "documents", "doc_id", "lang", "source"), {"lang": "fr", "source": ["src1", "src3", "src5"], "n_chars": None})


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%EXAMPLE.org/en%'")
def f3_ilike(spark, d):
    return _t(spark, d, "pages", "page_id", "url").filter(F.col("url").ilike("%EXAMPLE.org/en%"))


@query("SELECT doc_id, substr(text, 1, 2000) AS preview FROM documents WHERE doc_id = 42")
def f7_t2_point_lookup(spark, d):
    return _t(spark, d, "documents", "doc_id", "text").filter("doc_id = 42").select("doc_id", F.substring("text", 1, 2000).alias("preview"))


# --- context and citations


def _ranked_chunks(spark, d, *more: str):
    """The passages found with their texts, which stay where they are read: what was found goes to them."""
    found = written(_hybrid(spark, d).select("query_id", "doc_id", "rank"))
    return join_few(_t(spark, d, "documents", "doc_id", "source", "text", *more), found, ["doc_id"], ["doc_id"])


@query(f"""WITH {_hybrid_sql(20)}, h AS (SELECT query_id, doc_id, rank, text, len({_WORDS}) AS n_words FROM hybrid JOIN documents USING (doc_id))
 SELECT query_id, doc_id, rank, (sum({_TOKENS} + 50) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM h QUALIFY running <= 8000""")
def a2_token_budget(spark, d):
    return context.within_budget(_ranked_chunks(spark, d)).select("query_id", "doc_id", "rank", "running")


_ASK = rf"""{_hybrid_sql(20)}, h0 AS (SELECT query_id, doc_id, source, rank, text, len({_WORDS}) AS n_words, row_number() OVER (PARTITION BY query_id, doc_id, regexp_replace(substr(text, 1, 120), '^\s+|\s+$', '', 'g') ORDER BY rank) AS o FROM hybrid JOIN documents USING (doc_id)),
 h AS (SELECT *, sum({_TOKENS} + 50) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM h0 WHERE o = 1),
 i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h WHERE running <= 8000),
 x AS (SELECT query_id, string_agg('Source [' || i || '] | ' || source || chr(10) || text || chr(10), chr(10) ORDER BY i) AS text, count(*) AS n_chunks FROM i GROUP BY query_id),
 y AS (SELECT h.query_id, coalesce(any_value(x.text), 'No relevant sources found.') AS text, coalesce(any_value(n_chunks), 0) AS n_chunks, count(*) AS total FROM h LEFT JOIN x USING (query_id) GROUP BY h.query_id)"""


@query(f"WITH {_ASK} SELECT query_id, md5(text) AS context_md5, {_TOKENS} AS total_tokens, n_chunks, n_chunks < total AS truncated FROM (SELECT *, len({_WORDS}) AS n_words FROM y)")
def a3_ask_context(spark, d):
    return context.assemble(_ranked_chunks(spark, d), name="source").select("query_id", F.md5("context").alias("context_md5"), "total_tokens", "n_chunks", "truncated")


@query(f"WITH {_ASK} SELECT query_id, md5('<sources>' || chr(10) || text || chr(10) || '</sources>' || chr(10) || chr(10) || 'Question: What do the sources say?') AS prompt_md5 FROM y")
def a5_c19_prompt(spark, d):
    asked = context.prompt(T.rewrite_query(F.lit(QUESTION)), F.col("context"))
    return context.assemble(_ranked_chunks(spark, d), name="source").select("query_id", F.md5(asked).alias("prompt_md5"))


def _answers(spark, d):
    """Assistant turns, with markers in them that depend on the turn."""
    c = _t(spark, d, "conversations", "conv_id", "turn", "role", "text").filter("role = 'assistant'")
    marks = F.concat(F.lit(" [1]. And ["), ((F.col("turn") % 4) + 1).cast("string"), F.lit("] [1] [9]."))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.concat("text", marks).alias("answer"))


_ANSWERS = "ans AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, text || ' [1]. And [' || (turn % 4 + 1) || '] [1] [9].' AS answer FROM conversations WHERE role = 'assistant')"
_SRC = "ctx AS (SELECT ans.query_id, c.text, c.conv_id AS doc_id, row_number() OVER (PARTITION BY ans.query_id ORDER BY c.turn) AS rank FROM ans JOIN conversations c ON c.conv_id = ans.conv_id AND c.role = 'user')"


def _sources(spark, d, ans):
    """Each answer's sources: the user turns of its conversation, in order."""
    users = _t(spark, d, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))
    return ans.select("query_id", "conv_id").join(users, "conv_id").withColumn("rank", rank).withColumnRenamed("conv_id", "doc_id")


@query(rf"WITH {_ANSWERS}, {_SRC}, m AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\[(\d+)\]', 1))::BIGINT AS rank FROM ans) SELECT query_id, rank::INTEGER AS rank, doc_id, substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '…' ELSE '' END AS excerpt FROM m JOIN ctx USING (query_id, rank)")
def a6_j2_citations(spark, d):
    ans = _answers(spark, d)
    return context.citations(ans, _sources(spark, d, ans))


_SET = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]{{4,}}'))"


@query(rf"""WITH {_ANSWERS}, {_SRC}, m AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\[(\d+)\]', 1))::BIGINT AS rank FROM ans),
 c AS (SELECT m.query_id, m.rank, doc_id, text, regexp_extract(answer, '[^.!?]*\[' || m.rank || '\][^.!?]*[.!?]?') AS claim FROM m JOIN ctx USING (query_id, rank) JOIN ans USING (query_id)),
 s AS (SELECT *, {_SET.format('claim')} AS a, {_SET.format('text')} AS b FROM c)
 SELECT query_id, rank::INTEGER AS rank, doc_id, regexp_replace(substr(text, 1, 400), '^\s+|\s+$', '', 'g') || CASE WHEN length(text) > 400 THEN '…' ELSE '' END AS excerpt, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END::DOUBLE AS support FROM s""")
def a7_verified_citations(spark, d):
    ans = _answers(spark, d)
    return context.citations(ans, _sources(spark, d, ans), chars=400, verified=True)


@query(rf"WITH {_ANSWERS} SELECT query_id, regexp_extract(answer, '[^.!?]*\[1\][^.!?]*[.!?]?') AS claim FROM ans")
def a8_first_claim(spark, d):
    return _answers(spark, d).select("query_id", context.first_claim("answer", F.lit(1)).alias("claim"))


@query(f"WITH l AS (SELECT i.item_id, d.doc_id, {_SET.format('i.text')} AS a, {_SET.format('d.text')} AS b FROM benchmark i JOIN documents d ON d.doc_id = i.item_id) SELECT item_id, doc_id, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END::DOUBLE AS support FROM l")
def a9_u2_support(spark, d):
    i = _t(spark, d, "benchmark", "item_id", F.col("text").alias("claim"))
    return i.join(_t(spark, d, "documents", "doc_id", "text"), F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", T.support("claim", "text").alias("support"))


@query(rf"WITH {_ANSWERS}, {_SRC}, m AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\[(\d+)\]', 1))::BIGINT AS rank FROM ans), b AS (SELECT query_id, doc_id, min(rank) AS f FROM m JOIN ctx USING (query_id, rank) GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY f)::INTEGER AS number FROM b")
def a10_bibliography(spark, d):
    ans = _answers(spark, d)
    return context.bibliography(context.citations(ans, _sources(spark, d, ans)))


# --- catalogue


@query("SELECT lang, count(*) AS documents FROM documents GROUP BY lang")
def g2_documents_by_status(spark, d):
    return catalog.count_by(_t(spark, d, "documents"), "lang", "documents")


@query("SELECT event_type, count(*) AS jobs FROM events GROUP BY event_type")
def g3_jobs_by_status(spark, d):
    return catalog.count_by(_t(spark, d, "events"), "event_type", "jobs")


@query(f"WITH {_FIXED} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) AS indexed, (SELECT count(*) FROM chunks) AS chunks")
def g4_g5_corpus_stats(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels", "doc_id", "quality")
    parts = {
        "documents": docs,
        "indexed": docs.join(labels.filter("quality = 1"), "doc_id", "left_semi"),
        "chunks": chunk.fixed_chunks(docs),
    }
    rows = [df.select(*[F.lit(int(n == m)).cast("long").alias(m) for m in parts]) for n, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in parts])


@query(f"WITH {_hybrid_sql(50)} SELECT count(DISTINCT doc_id) AS documents, count(*) AS passages FROM hybrid")
def g6_topic_count(spark, d):
    return catalog.topic_count(_hybrid(spark, d, 50))


@query(f"WITH {_hybrid_sql(50)} SELECT *, row_number() OVER (ORDER BY passages DESC, first_rank, source)::INTEGER AS position FROM (SELECT coalesce(nullif(source, ''), 'Unknown') AS source, count(*) AS passages, min(rank) AS first_rank FROM hybrid LEFT JOIN documents USING (doc_id) GROUP BY 1)")
def g7_topic_by_department(spark, d):
    return catalog.topic_by(_hybrid(spark, d, 50).join(_t(spark, d, "documents", "doc_id", "source"), "doc_id", "left"), "source")


@query(f"WITH {_hybrid_sql(50)} SELECT *, row_number() OVER (ORDER BY passages DESC, first_rank, lang)::INTEGER AS position FROM (SELECT coalesce(nullif(lang, ''), 'Unknown') AS lang, count(*) AS passages, min(rank) AS first_rank FROM hybrid LEFT JOIN documents USING (doc_id) GROUP BY 1)")
def g8_topic_by_doc_type(spark, d):
    return catalog.topic_by(_hybrid(spark, d, 50).join(_t(spark, d, "documents", "doc_id", "lang"), "doc_id", "left"), "lang")


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, greatest(1, ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 20.0))::BIGINT AS total_pages FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def g9_list_page(spark, d):
    own = _t(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").filter("o_orderstatus = 'F'").drop("o_orderstatus")
    return catalog.page(own, 3, 20, F.desc("o_orderdate"), F.col("o_orderkey"))


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def g12_latest_job(spark, d):
    return catalog.latest(_t(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'pending' ELSE 'indexed' END AS status FROM labels")
def g13_retry_failed(spark, d):
    return catalog.retry_failed(_t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("indexed").alias("status")))


_BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000]


@query("SELECT source, le, n FROM (" + " UNION ALL ".join(f"SELECT source, '{float(b)}' AS le, count_if(n_chars <= {b})::BIGINT AS n FROM documents GROUP BY source" for b in _BOUNDS) + " UNION ALL SELECT source, '+Inf', count(n_chars) FROM documents GROUP BY source)")
def g16_histogram(spark, d):
    return catalog.histogram(_t(spark, d, "documents", "source", "n_chars"), "n_chars", _BOUNDS, "source")


@query("SELECT d.source, l.quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def j3_documents_with_labels(spark, d):
    return _t(spark, d, "documents", "doc_id", "source", "n_chars").join(_t(spark, d, "labels", "doc_id", "quality"), "doc_id").groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {_FIXED} SELECT doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j4_s15_cascade_delete(spark, d):
    gone = _t(spark, d, "labels").filter("toxic = 1")
    return catalog.delete(chunk.fixed_chunks(_t(spark, d, "documents")).select("doc_id", "chunk_index"), gone, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_orphans(spark, d):
    return catalog.orphans(_t(spark, d, "documents", "doc_id"), _t(spark, d, "labels"), "doc_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def u3_duplicate_texts(spark, d):
    return catalog.duplicate_texts(_t(spark, d, "documents", "text"))


@query("SELECT event_id, value FROM events WHERE value < 1 OR value > 5")
def v_rating_range(spark, d):
    return catalog.out_of_range(_t(spark, d, "events", "event_id", "value"), "value", 1, 5)


@query("SELECT doc_id, lang, coalesce(quality, -1)::INTEGER AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def s13_upsert(spark, d):
    """Labelled rows take the place of rows with a default."""
    from ..sources.files import upsert

    docs = _t(spark, d, "documents", "doc_id", "lang")
    own = docs.join(_t(spark, d, "labels", "doc_id", "quality"), "doc_id").select("doc_id", "lang", F.col("quality").cast("int").alias("quality"))
    return upsert(docs.withColumn("quality", F.lit(-1)), own, "doc_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def i6_event_windows(spark, d):
    return ingest.event_windows(_t(spark, d, "events"))


# --- markup


@query(r"SELECT page_id, replace(replace(replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages")
def x3_html_title(spark, d):
    return markup.html_metadata(_t(spark, d, "pages", "page_id", "html")).select("page_id", "title")


_ENTITIES = {"&copy;": "©", "&middot;": "·", "&nbsp;": " ", "&quot;": '"', "&#39;": "''", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _unescaped(x: str) -> str:
    for k, v in _ENTITIES.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x


#: The given pages hold one article each, whose text stands between tags; longer rules are tested on made pages.
_SECTIONS = rf"""b AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS b FROM pages),
 h AS (SELECT page_id, regexp_replace(regexp_replace({_unescaped("regexp_extract(b, '(?s)<h1>(.*?)</h1>', 1)")}, '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS h, regexp_replace(b, '(?s)^.*?</h1>', '') AS b FROM b),
 p AS (SELECT page_id, h, list_filter(list_transform(regexp_split_to_array(b, '<[^>]*>'), lambda x: regexp_replace(regexp_replace({_unescaped('x')}, '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS p FROM h),
 sections AS (SELECT page_id, 0 AS section_no, h AS heading, 1 AS level, array_to_string(p, chr(10) || chr(10)) AS text, false AS has_table FROM p WHERE len(p) > 0
  UNION ALL SELECT page_id, 0, NULL, 0, h, false FROM p WHERE len(p) = 0)"""


@query(f"WITH {_SECTIONS} SELECT page_id, section_no, heading, level, text, has_table FROM sections")
def x6_html_sections(spark, d):
    return markup.html_sections(_t(spark, d, "pages", "page_id", "html"))


@query(rf"""WITH RECURSIVE {_SECTIONS}, {_recursive_sql("(SELECT page_id || '|' || section_no AS k, text AS t FROM sections)")},
 x AS (SELECT page_id, section_no, heading, level, has_table, rc.text, n_words, row_number() OVER (PARTITION BY page_id ORDER BY section_no, rc.chunk_index) - 1 AS chunk_index FROM rc JOIN sections ON k = page_id || '|' || section_no)
 SELECT page_id, section_no, heading, level, has_table, text, {_TOKENS} AS token_count, length(text)::BIGINT AS char_count, chunk_index, md5(page_id || '|recursive|' || chunk_index) AS chunk_id FROM x""")
def k9_section_chunks(spark, d):
    return chunk.section_chunks(markup.html_sections(_t(spark, d, "pages", "page_id", "html")), key="page_id")


@query(rf"""WITH {_SECTIONS} SELECT page_id, text AS raw_text, len({_WORDS})::BIGINT AS word_count FROM sections""")
def x8_html_raw_text(spark, d):
    return markup.html_raw_text(_t(spark, d, "pages", "page_id", "html"))


@query(r"""WITH m AS (SELECT page_id, '<head><meta name="Author" content=" ' || page_id || ' "><meta property="og:url" content="' || url || '"><meta name="date" content=""><meta name="description" content="about ' || page_id || '"><meta property="article:modified_time" content="2020-01-02"></head>' AS head, url FROM pages)
 SELECT page_id, 'Page ' || page_id AS title, page_id::VARCHAR AS author, NULL::VARCHAR AS created, '2020-01-02' AS modified, url, 'about ' || page_id AS description,
 'article:modified_time=2020-01-02; author=' || page_id || '; description=about ' || page_id || '; og:url=' || url AS meta FROM m""")
def x3_html_metadata(spark, d):
    """Metadata planted on each page's address; the title comes from the file's name."""
    pages = _t(spark, d, "pages", "page_id", "url")
    page = F.col("page_id").cast("string")
    head = F.concat(F.lit('<head><meta name="Author" content=" '), page, F.lit(' "><meta property="og:url" content="'), "url", F.lit('"><meta name="date" content=""><meta name="description" content="about '), page, F.lit('"><meta property="article:modified_time" content="2020-01-02"></head>'))
    planted = pages.select("page_id", head.alias("html"), F.concat(F.lit("/in/page_"), page, F.lit(".html")).alias("path"))
    pairs = F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return markup.html_metadata(planted, name="path").withColumn("meta", F.array_join(pairs, "; "))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TEXT_SECTIONS = rf"""l AS (SELECT doc_id, i AS pos, t[i] AS line, {_STRIP.format('t[i]')} AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))),
 n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY pos), '') AS a FROM l),
 h AS (SELECT *, CASE WHEN s = '' OR regexp_matches(s, '^[=-]+$') THEN NULL WHEN regexp_matches(a, '^={{3,}}$') THEN 1 WHEN regexp_matches(a, '^-{{3,}}$') THEN 2
   WHEN regexp_matches(s, '^\d+(\.\d+)*\.?\s+\S') AND length(s) < 80 THEN least(3, length(regexp_replace(regexp_extract(s, '^\d+(\.\d+)*'), '[^.]', '', 'g')) + 1)
   WHEN upper(s) = s AND lower(s) <> s AND length(s) BETWEEN 3 AND 60 AND s NOT LIKE '%.' THEN 1 WHEN s LIKE '%:' AND length(s) <= 60 THEN 3 END AS level FROM n),
 u AS (SELECT *, regexp_matches(s, '^[=-]+$') AND coalesce(lag(level IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY pos), false) AS under FROM h),
 g AS (SELECT *, sum((level IS NOT NULL)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM u WHERE NOT under),
 k AS (SELECT doc_id, sec, max(CASE WHEN level = 3 AND s LIKE '%:' AND NOT regexp_matches(s, '^\d+(\.\d+)*\.?\s+\S') THEN rtrim(s, ':') WHEN level IS NOT NULL THEN s END) AS heading, coalesce(max(level), 0)::INTEGER AS level, {_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level IS NULL), '')")} AS text FROM g GROUP BY doc_id, sec)"""


@query(f"WITH {_TEXT_SECTIONS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INTEGER AS section_no, heading, level, text, false AS has_table FROM k WHERE text <> ''")
def x_text_sections(spark, d):
    return markup.text_sections(_t(spark, d, "documents", "doc_id", "text"))


def FLAGSHIP(spark, d):
    """The context of a batch of questions, end to end."""
    return context.assemble(_ranked_chunks(spark, d), name="source")
