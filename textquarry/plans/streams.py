"""Queries whose operators also run as streams: sessions, sliding windows, joins within a time, merges by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk
from ..storage import new_folder
from ..streaming import ingest
from ..streaming.sink import ChunkTable
from .registry import _WORDS, _t, query


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER o + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def i6_session_windows(spark, d):
    return ingest.session_windows(_t(spark, d, "events", "user_id", "ts", "value"), "user_id", "6 hours")


@query("""SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM
 (SELECT event_type, value, ts, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE for i in range(0, 4)]) AS w FROM events) GROUP BY ALL""")
def i6_sliding_windows(spark, d):
    return ingest.sliding_windows(_t(spark, d, "events", "ts", "event_type", "value"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id, a.ts AS first_ts, b.ts AS then_ts FROM events a JOIN events b USING (user_id)
 WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR""")
def i6_followed_within(spark, d):
    """Purchases within twelve hours of a click of the same user."""
    e = _t(spark, d, "events", F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    return ingest.followed_within(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "12 HOURS")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, w[:len(w) // 2] FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id % 3 = 0)),
 c AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 384) / 336.0))::BIGINT)) AS chunk_index FROM w WHERE len(w) > 0)
 SELECT doc_id, chunk_index, md5(array_to_string(w[chunk_index * 336 + 1 : chunk_index * 336 + 384], ' ')) AS text_md5 FROM c""")
def s13_merged_batches(spark, d):
    """All documents ingested, a third of them again with half of their words, and that batch once more: the replay changes
    nothing, and no chunk of the longer texts stays."""
    docs = _t(spark, d, "documents", "doc_id", "text")
    words = F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    half = docs.filter("doc_id % 3 = 0").select("doc_id", F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ").alias("text"))
    first, again = (chunk.fixed_chunks(x).select("doc_id", "chunk_id", "chunk_index", F.md5("text").alias("text_md5")) for x in (docs, half))
    table = ChunkTable(spark, new_folder(spark), first.schema)
    table.merge(first, 0, docs)
    for _ in range(2):
        table.merge(again, 1, half)
    return table.read().select("doc_id", "chunk_index", "text_md5")
