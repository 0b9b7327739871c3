"""Readers and writers, round trips and failure cases."""

import json

import pytest
from pyspark.sql import functions as F

from simsift.functions.classify import classify_log
from simsift.functions.sqlfunction import create_classifier
from simsift.operators.learn import fit_classifier
from simsift.session import scratch_path, shared_dir
from simsift.sources import readers as R
from simsift.sources import writers as W
from simsift.streaming.triage import request_stream, start_triage


def test_jsonl(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"log": "a — b", "label": "X"}\n\n   \n{"log": "c"}\n', encoding="utf-8")
    rows = R.read_jsonl(spark, str(path), "log string, label string")
    assert {tuple(r) for r in rows.collect()} == {("a — b", "X"), ("c", None)}
    W.write_jsonl(rows, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "—" in text and '{"log":"c"}' in text


def test_broken_line_raises(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"log": "a"}\n{"log": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        R.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "log string").collect()


def test_json_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, bug_type string").repartition(3)
    W.write_json_arrays(rows, str(tmp_path / "a"))
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "a").glob("part-*"))
    back = R.read_json_array(spark, str(tmp_path / "a"), "id int, bug_type string")
    assert sorted(tuple(r) for r in back.collect()) == [(i, f"t{i}") for i in range(10)]


def test_optional_report(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"accuracy": 0.5}')
    assert R.read_optional(spark, str(tmp_path / "r.json"), "accuracy double").first()[0] == 0.5
    assert R.read_optional(spark, str(tmp_path / "none.json"), "accuracy double") is None


def test_sources_and_skip_list(spark, tmp_path):
    (tmp_path / "fifo.v").write_text("module\nfifo")
    (tmp_path / "gpio.v").write_text("x")
    found = R.read_sources(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("fifo", "module\nfifo"), ("gpio", "x")}
    wanted = spark.createDataFrame([("fifo",), ("spi",)], "module string")
    assert [r[0] for r in R.missing_modules(wanted, found).collect()] == ["spi"]


def test_splits_reports_and_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "log string, split string")
    W.write_splits(rows, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    W.write_report(spark.sql("SELECT 1L AS total, 0.5D AS accuracy"), str(tmp_path / "r"))
    parts = list((tmp_path / "r").glob("part-*"))
    assert len(parts) == 1 and json.loads(parts[0].read_text()) == {"total": 1, "accuracy": 0.5}
    texts = spark.createDataFrame([("m1", "x", "one\ntwo"), ("m2", "x", "three")], "module string, mutation_id string, t string")
    W.write_text_per_row(texts, "t", str(tmp_path / "t"))
    logs = R.read_log_files(spark, str(tmp_path / "t/*"))
    assert sorted(r["log"] for r in logs.collect()) == ["one\ntwo\n", "three\n"]
    assert sorted(p.name for p in (tmp_path / "t").glob("*/*.log")) == ["m1_x.log", "m2_x.log"]


def test_text_files_share_folders_and_replace_each_other(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('m', id) AS module", "'x' AS mutation_id", "IF(id = 3, NULL, concat('é ', id)) AS t")
    for part in (rows, rows.filter("module < 'm2'")):
        W.write_text_per_row(part.repartition(4), "t", str(tmp_path / "t"))
    folders = [p for p in (tmp_path / "t").iterdir()]
    assert len(folders) <= 4 and all(f.name.startswith("part-") for f in folders)
    got = {p.name: p.read_text() for p in (tmp_path / "t").glob("*/*")}
    want = {f"{r.module}_x.log": (r.t or "") + "\n" for r in rows.filter("module < 'm2'").collect()}
    assert got == want


def test_failed_tasks_leave_no_text_files(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "concat('m', id) AS module", "'x' AS mutation_id", "IF(id = 77, raise_error('lost'), 'text') AS t"
    ).repartition(4)
    with pytest.raises(Exception, match="lost"):
        W.write_text_per_row(rows, "t", str(tmp_path / "t"))
    assert not list((tmp_path / "t").rglob("*.log"))
    double = spark.createDataFrame([("m", "x", "1"), ("m", "x", "2"), ("a/b", "x", "3")], "module string, mutation_id string, t string")
    for bad in (double.limit(2).coalesce(1), double.filter("module = 'a/b'")):
        with pytest.raises(Exception, match="no name of one file"):
            W.write_text_per_row(bad, "t", str(tmp_path / "u"))


def test_json_arrays_fail_fast(spark, tmp_path):
    schema = "id int, name string, at struct<x:double>"
    texts = {
        "a": '[{"id": 1, "name": "n", "at": {"x": 1.5}, "more": [1]},\n {"name": null}]', "b": "[]", "c": '{"id": 7}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = R.read_json_array(spark, str(tmp_path / "*.json"), schema).collect()
    assert sorted([(r.id, r.name, r["at"] and r["at"].x) for r in got], key=str) == [(1, "n", 1.5), (7, None, None), (None, None, None)]
    for bad in ('[{"id": 1}', '[{"id": "x"}]'):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception, match="MALFORMED|INVALID|CAST"):
            R.read_json_array(spark, str(tmp_path / "bad"), schema).collect()


def test_json_arrays_of_bounded_size(spark, tmp_path):
    W.write_json_arrays(spark.range(95).repartition(2), str(tmp_path / "a"), per_document=10)
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "a").glob("part-*")]
    assert sum(sizes) == 95 and max(sizes) <= 10


def test_sql_classifier(spark):
    before = {t.name for t in spark.catalog.listTables()}
    create_classifier(spark)
    texts = ["parity error", None, "VALID = 1\nready=0", "calm", "İt's a Watchdog exceeded", "ASSERT_FAIL count"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = rows.withColumn("b", classify_log(F.col("text")))
    got = spark.sql("SELECT text, classify_log(text) AS a, b FROM {rows}", rows=rows).collect()
    assert len(got) == 6 and all(r.a == r.b for r in got)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_triage_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "log": "parity error"}\n{"id": "2", "log": "calm"}\n')
    done = start_triage(
        request_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True
    )
    done.awaitTermination()
    got = {r["id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "Parity Check Removal", "2": "Unknown"}


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_classifier_learns(spark):
    rows = [("parity broken", "P"), ("counter too high", "C")] * 20
    data = spark.createDataFrame(rows, "log string, label string")
    model = fit_classifier(data, features=64, iterations=5)
    assert model.transform(data).filter("predicted = label").count() == 40
