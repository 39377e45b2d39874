"""Ingestion as a stream: files or tables in, chunks out, once for each document however often a batch is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import fixed_chunks


def chunk_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, size: int = 512, overlap: int = 64):
    """New Parquet files of documents under source become chunk files under sink. The file sink commits each batch once."""
    docs = spark.readStream.schema(schema).parquet(source)
    return fixed_chunks(docs, size, overlap).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()


def state_stream(spark: SparkSession, source: str, schema, on_batch, checkpoint: str):
    """Batches to a function; chunk ids depend on content alone, so a batch that comes again overwrites what it wrote."""
    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type (an extension); with `late`, the watermark that a stream needs."""
    own = events.withWatermark("ts", late) if late else events
    out = own.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_windows(events: DataFrame, by: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each `by`: runs of events less than a gap apart, with start, end (the gap after the last event), count and sum."""
    own = events.withWatermark("ts", late) if late else events
    out = own.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", F.round("total", 4).alias("total"))


def sliding_windows(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Counts and sums by overlapping windows and type."""
    own = events.withWatermark("ts", late) if late else events
    out = own.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def followed_within(first: DataFrame, then: DataFrame, by: str, bound: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Pairs of rows of one `by` in which `then` comes at most a bound after `first` (id, by, ts each). As streams, with
    `late`, the state of either side goes when the watermark has passed the bound."""
    a = first.select(F.col("id").alias("first_id"), F.col(by).alias("_a"), F.col("ts").alias("first_ts"))
    b = then.select(F.col("id").alias("then_id"), F.col(by), F.col("ts").alias("then_ts"))
    if late:
        a, b = a.withWatermark("first_ts", late), b.withWatermark("then_ts", late)
    met = a.join(b, (F.col("_a") == F.col(by)) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {bound}")))
    return met.select(by, "first_id", "then_id", "first_ts", "then_ts")
