"""Queries of learned sentence ends, the chunker as a table function, cache tiers, metrics of a run, and sketches by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import cache_tiers, punkt, sketches
from ..operators.run_metrics import RunMetrics
from ..sources import markup
from ..storage import written
from .registry import _SECTIONS, _TOKENS, _WORDS, _recursive_sql, _t, query
from .service import _PARSED, _ingested

_CORE = """regexp_replace(regexp_replace({0}, '^[("''\\[]+', ''), '[)"''\\],;:]+$', '')"""
_TYPE = "regexp_replace(lower(" + _CORE + "), '\\.$', '')"
_LEARNED = rf"""w AS (SELECT {_WORDS} AS w FROM documents), e AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w),
 o AS (SELECT {_TYPE.format('w[i]')} AS type, {_CORE.format('w[i]')} LIKE '%.' AS period, CASE WHEN i > 1 THEN w[i - 1] END AS after FROM e),
 k AS (SELECT * FROM o WHERE regexp_matches(type, '\p{{L}}')),
 c AS (SELECT type, count(*) AS n, count_if(period)::BIGINT AS with_period, length(replace(type, '.', '')) AS letters, length(type) - length(replace(type, '.', '')) AS inner_ FROM k GROUP BY type),
 t AS (SELECT sum(n) AS tn, sum(with_period)::DOUBLE AS tp FROM c),
 a AS (SELECT type, n, with_period, round(-2 * ((with_period * ln(tp / tn) + CASE WHEN n = with_period THEN 0 ELSE (n - with_period) * ln(1 - tp / tn) END) - (with_period * ln(0.99::DOUBLE) + (n - with_period) * ln(1 - 0.99::DOUBLE)))
   * exp(-letters) * (inner_ + 1) * pow(letters::DOUBLE, (with_period - n)::DOUBLE), 6) + 0.0 AS score FROM c, t WHERE with_period > 0)"""


@query(f"WITH {_LEARNED} SELECT * FROM a")
def k11_punkt_abbreviations(spark, d):
    return punkt.abbreviation_scores(_t(spark, d, "documents", "text"))


def _xlog(x: str, y: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE ({x}) * ln({y}) END"


@query(rf"""WITH {_LEARNED}, s AS (SELECT type, count(*)::DOUBLE AS b, count_if(after IS NOT NULL AND regexp_matches({_CORE.format('after')}, '[.!?]$') AND {_TYPE.format('after')} NOT IN (SELECT type FROM a WHERE score >= 0.3))::DOUBLE AS ab FROM k GROUP BY type),
 z AS (SELECT *, (sum(b) OVER ())::DOUBLE AS n, (sum(ab) OVER ())::DOUBLE AS m FROM s)
 SELECT type, b::BIGINT AS n, ab::BIGINT AS at_start, round(-2 * (({_xlog('b', 'b / n')} + {_xlog('n - b', '1 - b / n')}) - ({_xlog('ab', 'ab / m')} + {_xlog('m - ab', '1 - ab / m')}
  + {_xlog('b - ab', '(b - ab) / (n - m)')} + {_xlog('n - m - b + ab', '1 - (b - ab) / (n - m)')})), 6) AS score FROM z WHERE ab > 0 AND ab / m > b / n""")
def k11_punkt_starters(spark, d):
    return punkt.learned_tables(_t(spark, d, "documents", "text"))[1]


@query()
def k11_punkt_sentences(spark, d):
    docs = _t(spark, d, "documents", "doc_id", "text")
    abbreviations, starters = punkt.learned_tables(docs)
    model = punkt._over(abbreviations, punkt.ABBREVIATION), written(punkt._over(starters, punkt.STARTER))
    told = punkt.sentences_by(docs, *model).select("doc_id", F.posexplode("sentences"))
    return told.select("doc_id", (F.col("pos") + 1).cast("long").alias("position"), F.md5("col").alias("sentence"))


@query(rf"""WITH RECURSIVE {_SECTIONS}, {_recursive_sql("(SELECT page_id || '|' || section_no AS k, text AS t FROM sections)")},
 x AS (SELECT page_id, section_no, rc.text, n_words, row_number() OVER (PARTITION BY page_id ORDER BY section_no, rc.chunk_index) - 1 AS chunk_index FROM rc JOIN sections ON k = page_id || '|' || section_no)
 SELECT page_id, section_no, chunk_index, md5(page_id || '|recursive|' || chunk_index) AS chunk_id, text, {_TOKENS} AS token_count FROM x""")
def k9_table_function(spark, d):
    """The section chunks by a SQL table function that takes the sections by page, in order."""
    tables.register(spark)
    sections = markup.html_sections(_t(spark, d, "pages", "page_id", "html")).select("page_id", "section_no", "text")
    return spark.sql("SELECT * FROM section_chunks(TABLE({sections}), key => 'page_id')", sections=sections)


@query("""WITH u AS (SELECT user_id, max(100 + length(props))::BIGINT AS size, max(ts) AS last_used, count(*) AS uses FROM events GROUP BY user_id),
 b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY last_used DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u)
 SELECT *, CASE WHEN before + size <= 4000 THEN 1 WHEN before + size <= 14000 THEN 2 ELSE 0 END AS tier FROM b""")
def e3_cache_tiers(spark, d):
    """Users as cached entries, events as their uses."""
    log = _t(spark, d, "events", "user_id", (F.length("props") + 100).alias("size"), "ts")
    return cache_tiers.tiers(log, "user_id", "size", "ts", 4000, 10_000)


@query(f"""WITH {_PARSED} SELECT 'files' AS step, count(*) AS n FROM f UNION ALL SELECT 'documents', count(*) FROM p UNION ALL SELECT 'chunks', count(*) FROM chunks
 UNION ALL SELECT 'indexed', count(DISTINCT doc_id) FROM chunks""")
def i4_observed_run(spark, d):
    """What each step of a run adds, counted while the points are written: one pass, no job of its own."""
    run = RunMetrics()
    _, _, _, held = _ingested(spark, d, lambda df, step: run.observe(df, step) if step != "chunks" else run.observe(df, step, n=F.count(F.lit(1)), indexed=F.count_if(F.col("chunk_index") == 0)))
    written(held)
    told = run.table(spark).select(F.when(F.col("metric") == "n", F.col("step")).otherwise(F.col("metric")).alias("step"), F.col("value").cast("long").alias("n"))
    return told


@query()
def g16_merged_sketches(spark, d) -> DataFrame:
    """Distinct users and quartiles of values by month, merged from daily sketches, with the exact figures beside them."""
    events = _t(spark, d, "events", "ts", "user_id", "value")
    month = F.date_trunc("month", "day").cast("date").alias("month")
    exact = events.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.countDistinct("user_id").alias("exact"), F.expr("percentile(value, 0.5)").alias("exact_median"))
    return sketches.merged(sketches.daily(events, "ts", "user_id", "value"), month).join(exact, "month")
