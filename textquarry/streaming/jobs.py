"""Ingestion jobs as streams: acceptance once for each content, and the state of each job from its updates, with retries by timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import PROGRESS, RETRIES


def accept_stream(spark: SparkSession, folder: str, late: str = "1 day", glob: str = "*") -> DataFrame:
    """The job row of each new file content under folder: path, digest, job_id, status, progress, attempts, modified.

    A file that comes again, under any name, gives no second row while the watermark still knows it; after that its row
    has the same job_id, so a sink that is keyed by job_id stays the same.
    """
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    told = files.select("path", F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("modified"))
    once = told.withWatermark("modified", late).dropDuplicatesWithinWatermark(["digest"])
    return once.select("path", "digest", F.md5(F.concat(F.lit("job|"), "digest")).alias("job_id"), F.lit("pending").alias("status"), F.lit(0).alias("progress"), F.lit(0).alias("attempts"), "modified")


STATE = "attempts int, ok boolean, progress int, completed_at timestamp, last timestamp, error string, due timestamp, seen_at array<timestamp>, seen array<long>"
OUT = "job_id {kind}, attempts long, status string, progress int, completed_at timestamp, error string, retry_at timestamp, retry_due boolean"


def _naive(t) -> pd.Timestamp | None:
    return None if t is None or t is pd.NaT or pd.isna(t) else pd.Timestamp(t)


def job_stream(updates: DataFrame, late: str = "10 minutes", retries: int = RETRIES, pause: int = 30, most: int = 1000) -> DataFrame:
    """updates (job_id, step, error, ts; a stream) -> the state of each job whenever it changes, in update mode.

    A step says how far a job is; an error is a failed attempt; a row with neither is a success, which settles the job. Updates
    may come in any order within `late` of the newest, and any number of times: a job remembers the updates that can
    still be repeated. After a failure the job waits `pause` seconds of event time; then a row with retry_due says that it is to run
    again, if it has not succeeded and has failed at most `retries` times. The last row of each job is what the batch
    functions progress() and failures() make of the same log.
    """
    kind = updates.schema["job_id"].dataType.simpleString()
    own = updates.select("job_id", "step", "error", "ts", F.xxhash64("step", "error", "ts").alias("h")).withWatermark("ts", late)

    def row(key: tuple, s: dict, due: bool) -> pd.DataFrame:
        status = None if not s["attempts"] and not s["ok"] else "success" if s["ok"] else "failed" if s["attempts"] > retries else "retrying"
        error = (s["error"] or "")[:most] if status in ("failed", "retrying") else None
        again = s["last"] + pd.Timedelta(seconds=pause) if status == "retrying" else None
        return pd.DataFrame({"job_id": [key[0]], "attempts": [s["attempts"]], "status": [status], "progress": pd.array([s["progress"]], "int32"), "completed_at": pd.Series([s["completed_at"]], dtype="datetime64[ns]"), "error": [error], "retry_at": pd.Series([again], dtype="datetime64[ns]"), "retry_due": [due]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["attempts", "ok", "progress", "completed_at", "last", "error", "due", "seen_at", "seen"]
        s = dict(zip(names, state.get, strict=True)) if state.exists else dict(zip(names, (0, False, 0, None, None, None, None, [], []), strict=True))
        for name in ("completed_at", "last", "due"):
            s[name] = _naive(s[name])
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        rung = state.hasTimedOut
        held = {h: _naive(t) for t, h in zip(s["seen_at"], s["seen"], strict=True)}
        for batch in batches:
            for name, error, ts, h in zip(batch["step"], batch["error"], batch["ts"], batch["h"], strict=True):
                if int(h) in held:
                    continue
                ts = pd.Timestamp(ts)
                held[int(h)] = ts
                if name is not None and not pd.isna(name):
                    s["progress"] = max(s["progress"], PROGRESS.get(name, 0))
                    if name == "done":
                        s["completed_at"] = ts if s["completed_at"] is None else min(ts, s["completed_at"])
                elif error is not None and not pd.isna(error):
                    s["attempts"] += 1
                    if s["last"] is None or (ts, error) > (s["last"], s["error"]):
                        s["last"], s["error"], s["due"] = ts, error, ts + pd.Timedelta(seconds=pause)
                else:
                    s["ok"] = True
        held = {h: t for h, t in held.items() if t >= mark}  # older updates are dropped before they get here
        if rung or s["ok"] or s["attempts"] > retries:
            ring, s["due"] = rung and s["due"] is not None and not s["ok"] and s["attempts"] <= retries, None
        else:
            ring = False
        s["seen_at"], s["seen"] = list(held.values()), list(held)
        state.update(tuple(s[n] for n in names))
        if s["due"] is not None:
            state.setTimeoutTimestamp(max(int(s["due"].timestamp() * 1000), int(mark.timestamp() * 1000) + 1))
        yield row(key, s, ring)

    return own.groupBy("job_id").applyInPandasWithState(step, OUT.format(kind=kind), STATE, "update", GroupStateTimeout.EventTimeTimeout)
