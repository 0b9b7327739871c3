"""Feeds of logs: their size on disk, and no text in an exchange on the way there."""

import gzip
import re

from pyspark.sql import functions as F

from simsift.plans import derived as D
from simsift.plans import streams as P
from simsift.plans.classification import requests
from simsift.plans.queries import QUERIES


def _tables(spark, tmp_path):
    """Own events and documents, with repeated and null ids and a document that has a call."""
    rows = [(i % 40 if i < 44 else None, i % 5, "view" if i % 3 else "error") for i in range(46)] + [(-4, 1, "click")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user_id") * 7).cast("timestamp_ntz")
    events.withColumn("ts", at).write.parquet(f"{tmp_path}/events.parquet")
    texts = [(i, f"line {i} of a text\n" * 5) for i in range(20)] + [(None, "none"), (21, None), (3, "again")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_timed_requests_are_those_of_a_join_of_whole_requests(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    times = D.calls(spark, sf).select(F.col("call_id").alias("id"), "ts_us")
    first = times.agg(F.min("ts_us")).first()[0]
    ts = F.coalesce("ts_us", F.lit(first) - F.col("id") * 1_000_000).alias("ts_us")
    plain = requests(spark, sf).join(times, "id", "left").select("id", ts, "log")
    timed = P._timed_requests(spark, sf)
    assert timed.columns == plain.columns and plain.filter("id = -4").count() > 1
    assert timed.exceptAll(plain).isEmpty() and plain.exceptAll(timed).isEmpty()


def test_texts_of_requests_are_in_no_exchange(spark, tmp_path):
    timed = P._timed_requests(spark, _tables(spark, tmp_path))
    plan = timed._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range)partitioning|RoundRobin", plan)


def test_feed_of_wide_rows_is_packed_and_whole(spark, monkeypatch):
    rows = spark.range(2_000).select("id", (F.col("id") * 1_000).alias("ts_us"), F.repeat(F.lit("text "), 200).alias("log"))
    written = []
    monkeypatch.setattr(P.W, "write_jsonl", lambda df, path, **o: (written.append(df), df.write.options(**o).json(path)))
    folder, _ = P._feed(rows, "wide", {"id": 2**62}, wide=("log",))
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in written)
    read = spark.read.schema("id bigint, ts_us bigint, log string").json(folder)
    files = read.inputFiles()
    files = [f for f in files if "/last/" not in f]
    assert all(f.endswith(".json.gz") for f in files)
    size = sum(len(open(f.removeprefix("file://"), "rb").read()) for f in files)
    assert size < 2_000 * 1_000 / 3
    assert gzip.open(files[0].removeprefix("file://")).readline().startswith(b"{")
    assert read.filter("log IS NOT NULL").exceptAll(rows).isEmpty() and read.count() == 2_001


def test_batches_follow_the_steps_not_the_files(spark):
    rows = spark.range(0, 900, 1, 30).select("id", (F.col("id") * 1_000).alias("ts_us"), F.lit("t").alias("log"))
    folder, _ = P._feed(rows, "many", {"id": 2**62}, wide=("log",))
    stream = P._read_feed(spark, folder, "id bigint, ts_us bigint, log string")
    seen = []
    run = stream.writeStream.foreachBatch(lambda df, n: seen.append(df.count())).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(seen) == 901 and 2 <= len(seen) <= P.STEPS + 3


def test_routed_triage_joins_no_table_in_its_batches(spark, tmp_path, monkeypatch):
    """The model's texts come with the requests; a table would be read and dealt anew in every batch."""
    sf = _tables(spark, tmp_path)
    seen, run = [], P._run
    monkeypatch.setattr(P, "_run", lambda rows, name: (seen.append(rows), run(rows, name))[1])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = QUERIES["str1_routed_triage"].run(spark, sf)
    plan = seen[0]._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 1 and "parquet" not in plan
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert "model" in {r["explanation"].split(" ")[-1] for r in got.filter("explanation IS NOT NULL").collect()}


def test_texts_of_requests_are_those_of_a_later_join(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    texts = D.generated(D.sim_logs(spark, sf))
    plain = P._timed_requests(spark, sf).join(texts, "id", "left").select("id", "ts_us", "generated_text", "log")
    carried = P._timed_requests(spark, sf, texts)
    assert carried.columns == plain.columns and carried.filter("generated_text IS NULL").count() > 0
    assert carried.exceptAll(plain).isEmpty() and plain.exceptAll(carried).isEmpty()
