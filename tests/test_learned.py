"""Learned sentence ends, the table function, cache tiers, metrics of a run and sketches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textquarry.functions import tables
from textquarry.operators import cache_tiers, chunk, punkt, sketches
from textquarry.operators.run_metrics import RunMetrics, StreamMetrics, bucket_counts

TEXTS = [f"Then Dr. Brown met {a} at noon. The talk of Dr. Brown and Prof. Grey took long, e.g. an hour. The {b} went home! It rained. Noon came an hour late and home again it rained on us and went on." for a in ("Ann", "Bob", "Cid", "Dan") for b in ("cat", "dog", "owl", "fox", "hen") for _ in range(6)]


@pytest.fixture(scope="module")
def model(spark):
    return punkt.learn(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


def test_abbreviations_and_starters_are_learned(model):
    assert {"dr", "prof", "e.g"} <= set(model.abbreviations) and not {"noon", "home", "rained", "the"} & set(model.abbreviations)
    assert "the" in model.starters and "brown" not in model.starters


def test_sentences_by_the_model(spark, model):
    given = ["Dr. Brown left. The end. ", "See Prof. The end came", "no end at all", "", " \n", None, 'He said "Go home." Then, e.g. the cat!\nYes', "One.Two three. four"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(given)], "i int, text string, _x string")
    got = [r["sentences"] for r in punkt.sentences(df, model).orderBy("i").collect()]
    want = [["Dr. Brown left.", "The end."], ["See Prof.", "The end came"], ["no end at all"], [], [], None, ['He said "Go home."', "Then, e.g. the cat!", "Yes"], ["One.Two three.", "four"]]
    assert [g or [] for g in got] == [w or [] for w in want]
    none = punkt.learn(df.limit(0))
    assert none.abbreviations == [] and [r[0] for r in punkt.sentences(df.filter("i = 0"), none).select("sentences").collect()] == [["Dr.", "Brown left.", "The end."]]


def test_a_model_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(punkt, "MOST", 1)
    with pytest.raises(ValueError, match="more than 1 words"):
        punkt.learn(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


def test_a_model_of_tables_has_no_bound(spark, monkeypatch, tmp_path, model):
    from textquarry.plans import learned

    monkeypatch.setattr(punkt, "MOST", 1)
    texts = [*TEXTS, "Dr. Brown left. The end. ", "See Prof. The end came", "", " \n", None, 'He said "Go home." Then, (e.g. the cat!)\nYes', "the talk of Dr.", "Dr. Dr. The Prof.' The"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["position"]): r["sentence"] for r in learned.k11_punkt_sentences(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(punkt, "MOST", 20_000)
    own = punkt.sentences(docs, punkt.learn(docs)).select("doc_id", F.posexplode("sentences")).select("doc_id", F.col("pos") + 1, F.md5("col")).collect()
    assert got == {(r[0], r[1]): r[2] for r in own}
    tables_of = lambda ws: spark.createDataFrame([(w,) for w in ws], "type string")
    both = [f.orderBy("doc_id").select("sentences").collect() for f in (punkt.sentences(docs, model), punkt.sentences_by(docs, tables_of(model.abbreviations), tables_of(model.starters)))]
    assert both[0] == both[1]


def test_table_function(spark):
    tables.register(spark)
    rows = [(1, 0, "a b c. " * 300), (1, 2, "x y"), (1, 1, " "), (2, 0, None), (3, 5, "one"), (None, 0, "no id")]
    sections = spark.createDataFrame(rows, "doc_id long, section_no int, text string").repartition(3)
    got = spark.sql("SELECT * FROM section_chunks(TABLE({s}), key => 'doc_id', size => 100, overlap => 10)", s=sections)
    want = chunk.section_chunks(sections.filter("doc_id IS NOT NULL").withColumn("heading", F.lit(None)), 100, 10)
    key = lambda df: sorted((r["doc_id"], r["section_no"], r["chunk_index"], r["chunk_id"], r["text"], r["token_count"]) for r in df.filter("doc_id IS NOT NULL").collect())
    assert key(got) == key(want) and got.filter("doc_id IS NULL").count() == 1
    with pytest.raises(Exception, match="needs"):
        spark.sql("SELECT * FROM section_chunks(TABLE({s}), key => 'doc_id')", s=sections.drop("text")).collect()


def test_cache_tiers(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    log = [("a", 10, at(0)), ("b", 10, at(1)), ("c", 10, at(7300)), ("d", 25, at(7301)), ("a", 10, at(9000)), ("e", 10, at(1)), (None, 1, at(1)), ("f", 5, None)]
    df = spark.createDataFrame(log, "k string, n int, at timestamp")
    got = {r["k"]: (r["before"], r["tier"], r["uses"]) for r in cache_tiers.tiers(df, "k", "n", "at", 36, 20).collect()}
    assert got == {"a": (0, 1, 2), "d": (10, 1, 1), "c": (35, 2, 1), "b": (45, 2, 1), "e": (55, 0, 1)}
    again = df.unionByName(spark.createDataFrame([("e", 10, at(9999))], df.schema))
    old, new = (cache_tiers.tiers(x, "k", "n", "at", 36, 20) for x in (df, again))
    assert {r["k"] for r in cache_tiers.promoted(old, new, "k").collect()} == {"e"}
    assert cache_tiers.tiers(df.limit(0), "k", "n", "at", 1, 1).count() == 0


def test_run_and_stream_metrics(spark, tmp_path):
    run = RunMetrics("r1")
    seen = run.observe(spark.range(100), "rows")
    some = run.observe(seen.filter("id % 3 = 0"), "some", **bucket_counts(F.col("id"), [10, 50]), n=F.count(F.lit(1)))
    some.write.parquet(f"{tmp_path}/out")
    got = {(r["step"], r["metric"]): r["value"] for r in run.table(spark).collect()}
    assert got == {("rows", "n"): 100, ("some", "n"): 34, ("some", "le_10"): 4, ("some", "le_50"): 17, ("some", "le_inf"): 34}
    listener = StreamMetrics()
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("id long").parquet(f"{tmp_path}/out").observe("stream", F.count(F.lit(1)).alias("n"))
        q = source.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if listener.rows:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["value"] for r in listener.table(spark).filter("step = 'stream'").collect()) == 34


def test_sketches_stay_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 7001).alias("who"), (F.col("id") % 1000).alias("value"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("ts"))
    days = sketches.daily(rows, "ts", "who", "value")
    assert days.count() in (7, 8)
    one = sketches.merged(days).first()
    assert one["n"] == 60_000 and abs(one["about"] - 7001) < 0.05 * 7001
    assert abs(one["low"] - 250) < 25 and abs(one["median"] - 500) < 25 and abs(one["high"] - 750) < 25
