"""Queries of retrieval modes, an assistant's tools, ingestion jobs, request checks and pages of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, chunk, context, jobs, search, tools
from ..sources import files, points
from .prepare import _FILES, _files
from .registry import _CLEAN, _FIXED, _WORDS, _asked, _hybrid, _hybrid_sql, _ranked_chunks, _t, query


@query(f"""WITH {_hybrid_sql(10)}, with_terms AS (SELECT query_id FROM asked WHERE len(ts) > 0)
 SELECT 'dense' AS mode, query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds) SEMI JOIN with_terms USING (query_id) WHERE rank <= 10
 UNION ALL SELECT 'keyword', query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INTEGER AS rank FROM ks) WHERE rank <= 10
 UNION ALL SELECT 'hybrid', query_id, doc_id, score, rank FROM hybrid SEMI JOIN with_terms USING (query_id)""")
def r5_modes(spark, d):
    vectors, docs, asked = _t(spark, d, "embeddings", F.col("vec_id").alias("doc_id"), "embedding"), _t(spark, d, "documents", "doc_id", "text"), _asked(spark, d)
    parts = [search.retrieve(m, vectors, docs, asked, 10, "doc_id").select(F.lit(m).alias("mode"), "query_id", "doc_id", "score", "rank") for m in ("dense", "keyword", "hybrid")]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {_hybrid_sql(20)} SELECT query_id, doc_id, score, score AS original_score, rank FROM hybrid WHERE rank <= 5")
def r6_r7_rerank_nothing(spark, d):
    return search.rerank(_hybrid(spark, d), 5).select("query_id", "doc_id", "score", "original_score", "rank")


@query(rf"WITH {_hybrid_sql(20)} SELECT query_id, doc_id, rank FROM hybrid JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, lang, regexp_replace(substr(text, 1, 120), '^\s+|\s+$', '', 'g') ORDER BY rank) = 1")
def a1_context_dedup(spark, d):
    """One of the passages of a language that start alike."""
    return context.dedup(_ranked_chunks(spark, d, "lang"), doc="lang").select("query_id", "doc_id", "rank")


@query(f"WITH {_hybrid_sql(20)} SELECT query_id, doc_id, rank, round(score, 4) AS score, substr(coalesce(text, ''), 1, 800) AS text FROM hybrid LEFT JOIN documents USING (doc_id)")
def t1_search_tool(spark, d):
    return tools.search_results(_hybrid(spark, d), _t(spark, d, "documents", "doc_id", "text"), 999)


@query("SELECT doc_id, source, substr(text, 1, 2000) AS preview FROM documents WHERE source ILIKE '%RC7%' ORDER BY doc_id LIMIT 1")
def t2_document_by_name(spark, d):
    return tools.document(_t(spark, d, "documents", "doc_id", "source", "text"), name="RC7", filename="source").select("doc_id", "source", "preview")


@query("SELECT doc_id, substr(text, 1, 8000) AS content FROM documents WHERE doc_id = 7")
def t3_summary_content(spark, d):
    return tools.document(_t(spark, d, "documents", "doc_id", "text"), 7).select("doc_id", F.substring("text", 1, tools.CONTENT_CHARS).alias("content"))


@query(f"""WITH {_FIXED} SELECT 'documents' AS metric, '' AS value, count(*) AS n FROM documents UNION ALL SELECT 'chunks', '', count(*) FROM chunks
 UNION ALL SELECT 'by_department', coalesce(nullif(source, ''), 'Unknown'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'by_doc_type', coalesce(nullif(lang, ''), 'Unknown'), count(*) FROM documents GROUP BY 2""")
def t4_analysis(spark, d):
    docs = _t(spark, d, "documents")
    return tools.analysis(docs, chunk.fixed_chunks(docs), by_department="source", by_doc_type="lang")


@query("SELECT doc_id, md5('job|' || doc_id) AS job_id, 'pending' AS status, 0 AS progress, 0 AS attempts FROM documents")
def i1_accepted(spark, d):
    return jobs.accepted(_t(spark, d, "documents", "doc_id"))


_STEPS = ("parse", "chunk", "embed", "upsert", "persist", "done")
_STEP = f"{list(_STEPS)}[event_id * 7 // 3 % 6 + 1]"


@query(f"SELECT user_id AS job_id, max([10, 30, 55, 75, 90, 100][event_id * 7 // 3 % 6 + 1])::INTEGER AS progress, min(ts) FILTER ({_STEP} = 'done') AS completed_at FROM events GROUP BY user_id")
def i2_progress(spark, d):
    """Events as the updates of jobs, one for each user."""
    at = (F.floor(F.col("event_id") * 7 / 3) % 6 + 1).cast("int")
    return jobs.progress(_t(spark, d, "events", F.col("user_id").alias("job_id"), F.element_at(F.array(*[F.lit(s) for s in _STEPS]), at).alias("step"), "ts"))


@query("""WITH e AS (SELECT user_id % 40 * 1000 + (ts::DATE - DATE '2024-01-01') AS job_id, event_type IN ('error', 'click', 'view') AS bad, event_type = 'signup' AND value > 20 AS ok, ts, props FROM events),
 a AS (SELECT job_id, count_if(bad)::BIGINT AS attempts, bool_or(ok) AS won, max(ts) FILTER (bad) AS last, arg_max(props, ts) FILTER (bad) AS error FROM e WHERE bad OR ok GROUP BY job_id),
 s AS (SELECT *, CASE WHEN won THEN 'success' WHEN attempts > 3 THEN 'failed' ELSE 'retrying' END AS status FROM a)
 SELECT job_id, attempts, status, CASE WHEN status <> 'success' THEN error END AS error, CASE WHEN status = 'retrying' THEN last + INTERVAL 30 SECOND END AS retry_at FROM s""")
def i3_failures(spark, d):
    """Errors, clicks and views as failures of jobs, signups of a high value as their success."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    bad = F.col("event_type").isin("error", "click", "view")
    own = _t(spark, d, "events").filter(bad | ((F.col("event_type") == "signup") & (F.col("value") > 20)))
    return jobs.failures(own.select((F.col("user_id") % 40 * 1000 + day).alias("job_id"), F.when(bad, F.col("props")).alias("error"), "ts"))


_PARSED = rf"""{_FILES}, p AS (SELECT stem AS doc_id, {_CLEAN} AS text FROM f WHERE suffix IN ('txt', 'md', 'log')),
 w AS (SELECT doc_id, {_WORDS} AS w FROM p),
 c AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 384) / 336.0))::BIGINT)) AS chunk_index FROM w WHERE len(w) > 0),
 chunks AS (SELECT doc_id, chunk_index, array_to_string(w[chunk_index * 336 + 1 : chunk_index * 336 + 384], ' ') AS text, md5(doc_id || '|fixed|' || chunk_index) AS chunk_id FROM c)"""


def _ingested(spark, d, seen=lambda df, step: df):
    """From files to points in one plan: read by suffix, clean, cut, key. Returns the files, their texts, chunks and points;
    each of the first three goes through seen(df, step) before the next is made of it."""
    given = seen(_files(spark, d), "files")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    texts = seen(files.text_documents(given).select(stem.alias("doc_id"), F.col("raw_text").alias("text")), "documents")
    made = seen(chunk.fixed_chunks(texts), "chunks")
    held = points.to_points(made.select("chunk_id", "doc_id", "chunk_index", "text", F.lit(None).cast("array<double>").alias("embedding")))
    return given, texts, made, held


@query(f"""WITH {_PARSED} SELECT 'files' AS step, count(*) AS n FROM f UNION ALL SELECT 'documents', count(*) FROM p UNION ALL SELECT 'chunks', count(*) FROM chunks
 UNION ALL SELECT 'points', count(DISTINCT chunk_id) FROM chunks UNION ALL SELECT 'indexed', count(DISTINCT doc_id) FROM chunks""")
def i4_ingested(spark, d):
    """What each step of one run adds; a second run adds the same keys."""
    given, texts, made, held = _ingested(spark, d)
    index = files.index_records(texts, made).filter("status = 'indexed'")
    steps = {"files": given, "documents": texts, "chunks": made, "points": held.select("point_id").distinct(), "indexed": index}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("step"), "n") for m, df in steps.items()])


@query(f"""WITH {_PARSED}, g AS (SELECT md5(stem || '|fixed|' || 0) AS chunk_id FROM f WHERE doc_id % 3 = 0)
 SELECT count(*) FILTER (chunk_id IN (SELECT chunk_id FROM g)) AS deleted, count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM g)) AS left_over FROM chunks""")
def s14_deleted_points(spark, d):
    """Points deleted by the ids of their chunks, with a true count: some of the ids asked for are in no table."""
    given, _, _, held = _ingested(spark, d)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    asked = given.filter("doc_id % 3 = 0").select(points.point_id(chunk.chunk_id(stem, "fixed", F.lit(0))).alias("point_id"))
    return points.deleted(held, asked)


@query("SELECT conv_id * 1000 + turn AS id, 'q ' || conv_id || '.' || turn AS question, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS ground_truth, len(['a', role]) AS n_contexts FROM conversations WHERE turn % 5 <> 4")
def s12_questions(spark, d):
    """Evaluation questions as JSON lines, some of them blank."""
    c = _t(spark, d, "conversations", "conv_id", "turn", "role", "text")
    asked = F.concat(F.lit("q "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    line = F.to_json(F.struct(asked.alias("question"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("ground_truth"), F.array(F.lit("a"), "role").alias("contexts")))
    told = files.parse_questions(c.select(F.when(F.col("turn") % 5 == 4, "  ").otherwise(line).alias("value")))
    parts = F.split(F.substring("question", 3, 100), r"\.")
    return told.select((parts[0].cast("long") * 1000 + parts[1].cast("long")).alias("id"), "question", "ground_truth", F.size("contexts").cast("long").alias("n_contexts"))


@query("SELECT md5(text) AS key, count(*) AS n FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY text HAVING max(doc_id) * 60 < 30000) GROUP BY 1")
def e3_expired_cache(spark, d):
    """Texts that were cached a minute for each id before noon: those older than 30,000 seconds are embedded anew."""
    docs = _t(spark, d, "documents", "doc_id", "text")
    noon = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    cache = docs.groupBy(F.md5("text").alias("key")).agg(F.max("doc_id").alias("age")).select("key", (F.timestamp_seconds(F.unix_timestamp(noon) - F.col("age") * 60)).alias("cached_at"))
    hits, _ = catalog.cache_split(docs.select("text"), cache, now=noon, ttl_seconds=30_000)
    return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(text) AS text_md5, ['UTF-8', 'ISO-8859-1', 'UTF-16LE', 'UTF-16BE', 'UTF-8'][doc_id % 5 + 1] AS encoding FROM documents WHERE doc_id % 5 <> 1 OR NOT regexp_matches(text, '^[\\x00-\\x7f]*$')")
def s4_decoded(spark, d):
    """Texts as bytes in several encodings, with and without marks, and back. (Latin-1 that is ASCII is UTF-8 too.)"""
    docs = _t(spark, d, "documents", "doc_id", "text").filter("doc_id % 5 <> 1 OR NOT text RLIKE '^[\\\\x00-\\\\x7f]*$'")
    kinds = [("UTF-8", ""), ("ISO-8859-1", ""), ("UTF-16LE", "FFFE"), ("UTF-16BE", "FEFF"), ("UTF-8", "EFBBBF")]
    made = F.array(*[F.concat(F.unhex(F.lit(mark)), F.encode("text", name)) for name, mark in kinds])
    held = docs.select("doc_id", F.element_at(made, (F.col("doc_id") % 5 + 1).cast("int")).alias("content"))
    return held.select("doc_id", F.md5(files.decoded("content")).alias("text_md5"), files.encoding("content").alias("encoding"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(lang || ', ' || source || ' ,, x ', ','), lambda t: trim(t)), lambda u: u <> ''), '|') AS tags FROM documents")
def s11_tags(spark, d):
    docs = _t(spark, d, "documents", "doc_id", "lang", "source")
    given = docs.select("doc_id", F.concat("lang", F.lit(", "), "source", F.lit(" ,, x ")).alias("given"))
    return given.select("doc_id", F.array_join(files.tags(F.col("given")), "|").alias("tags"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'running' ELSE 'pending' END AS status FROM labels WHERE toxic = 1 OR quality <> 1")
def g14_retryable(spark, d):
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "running").otherwise("pending")
    return jobs.retryable(_t(spark, d, "labels", "doc_id", status.alias("status")))


@query("SELECT conv_id, turn, text, count(*) OVER () AS total, greatest(1, ceil(count(*) OVER () / 3.0))::BIGINT AS total_pages FROM conversations WHERE conv_id = 7 ORDER BY turn LIMIT 3")
def g10_feedback_page(spark, d):
    return catalog.page(_t(spark, d, "conversations", "conv_id", "turn", "text").filter("conv_id = 7"), 1, 3, F.col("turn"))


@query("SELECT event_id, ts, count(*) OVER () AS total, greatest(1, ceil(count(*) OVER () / 50.0))::BIGINT AS total_pages FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")
def g11_runs_page(spark, d):
    return catalog.page(_t(spark, d, "events", "event_id", "ts", "event_type").filter("event_type = 'purchase'").drop("event_type"), 2, 50, F.desc("ts"), F.col("event_id"))


@query("SELECT round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic FROM labels")
def g15_metric_means(spark, d):
    return catalog.means(_t(spark, d, "labels"), "quality", "toxic").select(F.round("quality", 9).alias("quality"), F.round("toxic", 9).alias("toxic"))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT length(text) BETWEEN 1 AND 200 THEN 'chars' END, CASE WHEN NOT turn BETWEEN 0 AND 2 THEN 'turn' END, CASE WHEN role <> 'user' THEN 'role' END) AS violations FROM conversations")
def f8_f9_request_bounds(spark, d):
    asked = _t(spark, d, "conversations", "conv_id", "turn", "role", F.length("text").alias("chars"))
    return catalog.violations(asked, {"chars": (1, 200), "turn": (0, 2)}, {"role": ("user",)}).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("SELECT conv_id, turn, md5('Represent this sentence for retrieval: ' || text) AS query_md5 FROM conversations WHERE role = 'user'")
def e7_query_prefix(spark, d):
    own = _t(spark, d, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    return own.select("conv_id", "turn", F.md5(F.concat(F.lit("Represent this sentence for retrieval: "), "text")).alias("query_md5"))
