"""Ingestion state as tables: acceptance, progress, failure and retries, from a log of updates in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Per cent done when a step has ended.
PROGRESS = {"parse": 10, "chunk": 30, "embed": 55, "upsert": 75, "persist": 90, "done": 100}
RETRIES = 3


def accepted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The job row of each new document."""
    return docs.select(key, F.md5(F.concat_ws("|", F.lit("job"), F.col(key).cast("string"))).alias("job_id"), F.lit("pending").alias("status"), F.lit(0).alias("progress"), F.lit(0).alias("attempts"))


def progress(updates: DataFrame, key: str = "job_id") -> DataFrame:
    """updates (key, step, ts) -> key, progress (the furthest step), completed_at (when it first was done, else null)."""
    at = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv]), F.col("step"))
    done = F.min(F.when(F.col("step") == "done", F.col("ts")))
    return updates.groupBy(key).agg(F.coalesce(F.max(at), F.lit(0)).alias("progress"), done.alias("completed_at"))


def failures(updates: DataFrame, key: str = "job_id", retries: int = RETRIES, pause: int = 30, most: int = 1000) -> DataFrame:
    """updates (key, error, ts), null error: success -> key, attempts, status, error (its start), retry_at.

    A success settles a job; else it is retried after a pause until it has failed more than `retries` times.
    """
    bad = F.col("error").isNotNull()
    own = updates.groupBy(key).agg(F.count_if(bad).alias("attempts"), F.bool_or(~bad).alias("_ok"), F.max(F.when(bad, F.struct("ts", "error"))).alias("_last"))
    status = F.when(F.col("_ok"), "success").when(F.col("attempts") > retries, "failed").otherwise("retrying")
    out = own.withColumn("status", status)
    again = F.when(F.col("status") == "retrying", F.col("_last.ts") + F.make_dt_interval(secs=F.lit(pause)))
    return out.select(key, "attempts", "status", F.when(F.col("status") != "success", F.substring("_last.error", 1, most)).alias("error"), again.alias("retry_at"))


def retryable(docs: DataFrame, status: str = "status") -> DataFrame:
    """Failed and pending ones; those that run are left alone."""
    return docs.filter(F.col(status).isin("failed", "pending"))
