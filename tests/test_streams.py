"""Streams against the batch functions on the same log: late, repeated and shuffled updates, restarts, replays."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textquarry.operators import chunk, jobs
from textquarry.streaming import ingest
from textquarry.streaming import jobs as streams
from textquarry.streaming.sink import ChunkTable

AT = dt.datetime(2024, 1, 1, 12)
LOG = "job_id long, step string, error string, ts timestamp"


def log(n=40, seed=4):
    """Updates of n jobs in order of time: steps, failures, successes."""
    rnd, rows = random.Random(seed), []
    for job in range(n):
        t = AT + dt.timedelta(seconds=rnd.randint(0, 300))
        for step in list(jobs.PROGRESS)[: rnd.randint(0, 6)]:
            t += dt.timedelta(seconds=rnd.randint(1, 40))
            rows.append((job, step, None, t))
        for i in range(rnd.choice([0, 0, 1, 2, 4, 5])):
            t += dt.timedelta(seconds=rnd.randint(1, 90))
            rows.append((job, None, f"error {i}" * 40, t))
        if rnd.random() < 0.4:
            rows.append((job, None, None, t + dt.timedelta(seconds=5)))
    return sorted(rows, key=lambda r: r[3])


def run(spark, updates, folder, batches):
    """Feed the batches one at a time, each by a new start of the stream; returns all rows that came out, with their batch."""
    source, out, check = f"{folder}/in", [], f"{folder}/cp"
    Path(source).mkdir(parents=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        held = spark.readStream.schema(LOG).parquet(source)
        q = updates(held).writeStream.outputMode("update").foreachBatch(lambda df, b, i=i: out.extend((i, b, r) for r in df.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return out


def test_job_stream_equals_the_batch(spark, tmp_path):
    rows = log()
    rnd = random.Random(1)
    parts = [rows[i::3] for i in range(3)]  # out of order over the batches
    parts = [p + rnd.sample(rows, 12) for p in parts]  # repeats, within a batch and across restarts
    for p in parts:
        rnd.shuffle(p)
    end = [(999, "parse", None, AT + dt.timedelta(hours=5))]
    out = run(spark, lambda s: streams.job_stream(s, "1 hour"), tmp_path, [*parts, end, end])
    last = {}
    for _, _, r in out:
        last[r["job_id"]] = r
    whole = spark.createDataFrame(rows + end, LOG)
    want = {r["job_id"]: r for r in jobs.progress(whole.filter("step IS NOT NULL")).collect()}
    for j, r in last.items():
        assert r["progress"] == (want[j]["progress"] if j in want else 0) and r["completed_at"] == (want[j]["completed_at"] if j in want else None)
    bad = {r["job_id"]: r for r in jobs.failures(whole.filter("step IS NULL")).collect()}
    assert set(bad) <= set(last)
    for j, r in last.items():
        w = bad.get(j)
        assert (r["attempts"], r["status"], r["error"], r["retry_at"]) == ((w["attempts"], w["status"], w["error"], w["retry_at"]) if w else (0, None, None, None))
    due = [r for _, _, r in out if r["retry_due"]]
    waiting = {j for j, w in bad.items() if w["status"] == "retrying"}
    assert {r["job_id"] for r in due} >= waiting and all(r["attempts"] <= jobs.RETRIES for r in due)
    assert all(r["status"] == "retrying" for r in due)


def test_late_updates_are_dropped(spark, tmp_path):
    first = [(1, "parse", None, AT), (2, "parse", None, AT + dt.timedelta(hours=3))]
    late = [(1, "done", None, AT + dt.timedelta(minutes=1)), (2, "chunk", None, AT + dt.timedelta(hours=3, seconds=1))]
    out = run(spark, lambda s: streams.job_stream(s, "10 minutes"), tmp_path, [first, late])
    last = {r["job_id"]: r["progress"] for _, _, r in out}
    assert last == {1: 10, 2: 30}


def test_acceptance_once_for_each_content(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)

    def accept():
        accepted = streams.accept_stream(spark, str(folder))
        accepted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["digest"], r["job_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.txt").write_text("one text")
    (folder / "sub" / "b.txt").write_text("another")
    before = accept()
    assert len(before) == 2
    (folder / "again.md").write_text("one text")  # the same content under another name, after a restart
    assert accept() == before
    (folder / "c.txt").write_text("new")
    assert len(accept()) == 3


def chunks(docs):
    return chunk.fixed_chunks(docs, 8, 2).select("doc_id", "chunk_id", "chunk_index", "text")


def words(n, name):
    return " ".join(f"{name}{i}" for i in range(n))


def test_merged_batches(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, again, gone = docs([(i, words(40, "a")) for i in range(30)] + [(None, "no id")]), docs([(3, words(9, "b")), (90, "new")]), docs([(4, ""), (5, None)])
    table = ChunkTable(spark, str(tmp_path / "t"), chunks(first).schema, buckets=8)
    assert table.read().count() == 0 and table.merge(chunks(first), 0, first) and table.commits() == [0]
    n = table.read().count()
    assert n == chunks(first).count()
    state = lambda: sorted(map(str, table.read().collect()))
    assert table.merge(chunks(again), 1, again)
    once = state()
    assert {r["text"][0] for r in table.read().filter("doc_id = 3").collect()} == {"b"}  # no chunk of the longer text is left
    assert not table.merge(chunks(again), 1, again) and not table.merge(chunks(first), 0, first) and state() == once
    assert table.merge(chunks(gone), 2, gone) and table.read().filter("doc_id IN (4, 5)").count() == 0
    before = state()
    assert table.vacuum() > 0 and state() == before


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, words(40, "a"))], "doc_id long, text string")
    table = ChunkTable(spark, str(tmp_path / "t"), chunks(docs).schema)
    table.merge(chunks(docs), 0, docs)
    shorter = spark.createDataFrame([(1, "b")], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(ChunkTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(chunks(shorter), 1, shorter)
    assert table.read().count() == chunks(docs).count()
    assert table.merge(chunks(shorter), 1, shorter) and table.read().count() == 1


def test_state_streams_and_replays(spark, tmp_path):
    source = f"{tmp_path}/in"
    docs = spark.createDataFrame([(i, words(30, f"d{i}x")) for i in range(10)], "doc_id long, text string")
    docs.write.parquet(source)
    table = ChunkTable(spark, str(tmp_path / "t"), chunks(docs).schema, buckets=4)
    start = lambda check: table.stream(spark.readStream.schema(docs.schema).parquet(source), chunks, f"{tmp_path}/{check}").awaitTermination(120)
    start("cp")
    held = sorted(map(str, table.read().collect()))
    assert table.commits() == [0] and len(held) == chunks(docs).count()
    start("cp")  # nothing new
    start("lost")  # a lost checkpoint replays batch 0
    assert table.commits() == [0] and sorted(map(str, table.read().collect())) == held
    spark.createDataFrame([(3, "short")], "doc_id long, text string").write.mode("append").parquet(source)
    start("cp")
    assert [r["text"] for r in table.read().filter("doc_id = 3").collect()] == ["short"]
    seen = []
    ingest.state_stream(spark, source, docs.schema, lambda df, i: seen.append((i, df.count())), f"{tmp_path}/s").awaitTermination(120)
    ingest.state_stream(spark, source, docs.schema, lambda df, i: seen.append((i, df.count())), f"{tmp_path}/s").awaitTermination(120)
    assert seen == [(0, 11)]


def feed(spark, tmp_path, make, batches, schema):
    """What a stream over the batches appends, one start for each."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out)


def test_sessions_and_windows_drop_late_rows(spark, tmp_path):
    schema = "user_id long, event_type string, ts timestamp, value double"
    at = lambda m: AT + dt.timedelta(minutes=m)
    rows = [(1, "a", at(0), 1.0), (1, "a", at(10), 2.0), (1, "a", at(50), 4.0), (2, "a", at(5), 8.0)]
    end = [(9, "z", at(600), 0.0)]
    late = [(1, "a", at(3), 100.0)]
    got = feed(spark, tmp_path / "s", lambda s: ingest.session_windows(s, "user_id", "20 minutes", "30 minutes"), [rows, end, late, [(9, "z", at(1200), 0.0)]], schema)
    held = {(r["user_id"], r["session_start"], r["n"], r["total"]) for r in got.filter("user_id < 9").collect()}
    assert held == {(1, at(0), 2, 3.0), (1, at(50), 1, 4.0), (2, at(5), 1, 8.0)}
    got = feed(spark, tmp_path / "w", lambda s: ingest.sliding_windows(s, "20 minutes", "10 minutes", "30 minutes"), [rows, end, late, [(9, "z", at(1200), 0.0)]], schema)
    want = ingest.sliding_windows(spark.createDataFrame(rows, schema), "20 minutes", "10 minutes")
    assert sorted(map(str, got.filter("event_type = 'a'").collect())) == sorted(map(str, want.collect()))


def test_a_join_within_a_time(spark, tmp_path):
    schema = "id long, user_id long, kind string, ts timestamp"
    at = lambda m: AT + dt.timedelta(minutes=m)
    rows = [(1, 1, "q", at(0)), (2, 1, "a", at(5)), (3, 1, "a", at(11)), (4, 2, "a", at(2)), (5, 1, "q", at(9))]
    make = lambda s: ingest.followed_within(s.filter("kind = 'q'"), s.filter("kind = 'a'"), "user_id", "10 MINUTES", "30 minutes")
    got = feed(spark, tmp_path, make, [rows[:1], rows[1:], [(8, 9, "q", at(600)), (9, 9, "a", at(600))], [(10, 1, "a", at(6))]], schema)
    pairs = {(r["first_id"], r["then_id"]) for r in got.collect()}
    assert pairs == {(1, 2), (5, 3), (8, 9)}
    batch = ingest.followed_within(*(spark.createDataFrame(rows, schema).filter(F.col("kind") == k) for k in "qa"), "user_id", "10 MINUTES")
    assert {(r["first_id"], r["then_id"]) for r in batch.collect()} == {(1, 2), (5, 3)}
