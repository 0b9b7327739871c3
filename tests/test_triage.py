"""Size check, tail cut, gate, prompts, generated text, full triage."""

import json

import pytest
from pyspark.sql import functions as F

from simsift.catalog import labels as L
from simsift.functions import generated as G
from simsift.functions import triage as TR
from simsift.functions.textforms import fixed, percent
from simsift.operators import triage as OT
from simsift.operators.defaults import USES, with_defaults
from simsift.operators.pairs import training_pairs
from simsift.streaming.triage import routed_triage


def column(spark, values, kind, fn):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_lengths_at_the_limits(spark):
    sizes = [49_999, 50_000, 50_001, 100_000, 100_001]
    texts = ["é" * n for n in sizes]
    assert column(spark, texts, "string", TR.too_long) == [False, False, False, False, True]
    cut = column(spark, texts, "string", TR.keep_tail)
    marker = "... [TRUNCATED] ...\n"
    assert [len(c) for c in cut] == [49_999, 50_000] + [50_000 + len(marker)] * 3
    assert column(spark, cut, "string", TR.keep_tail) == cut


def test_gate(spark):
    rows = spark.createDataFrame(
        [(0, ("A", "x", 0.42)), (1, ("A", "x", 0.7)), (2, ("A", "x", None))],
        "i int, v struct<label:string,explanation:string,confidence:double>",
    )
    low, kept, missing = [r[0] for r in rows.orderBy("i").select(TR.gate(F.col("v"))).collect()]
    assert tuple(low) == ("Unknown", "Low-confidence classification (0.42 < 0.70). Check manually.", 0.42)
    assert tuple(kept) == ("A", "x", 0.7)
    assert (missing["label"], missing["confidence"]) == ("Unknown", 0.0)


def test_fixed_rounds_like_printf(spark):
    values = [0.125, 2.675, 1.005, 0.5, 1234.5]
    assert column(spark, values, "double", lambda c: fixed(c, 2)) == [f"{v:.2f}" for v in values]
    assert column(spark, [0.5617977528089888], "double", percent) == ["56.2%"]


def test_target_defaults(spark):
    rows = spark.createDataFrame([(None, None, None)], "l string, e string, c double")
    text = rows.select(TR.target_json(F.col("l"), F.col("e"), F.col("c"))).first()[0]
    assert json.loads(text) == {
        "label": "Unknown", "explanation": "No explanation available.", "confidence": 1.0
    }


def test_defaults_by_use(spark):
    rows = spark.createDataFrame(
        [(0, None, None, None, None), (1, 7, "L", "A", 0.5), (2, None, "", None, None)],
        "n int, id int, log string, label string, confidence double",
    )
    found = {u: [tuple(r)[1:] for r in with_defaults(rows, u, ["n"]).orderBy("n").collect()] for u in USES}
    assert found["natural"] == [("unknown", "", "Unknown", 0.0), ("7", "L", "A", 0.5), ("unknown", "", "Unknown", 0.0)]
    assert found["evaluation"] == [("test_0", "", "Unknown", 0.0), ("7", "L", "A", 0.5), ("test_2", "", "Unknown", 0.0)]
    assert [r[0] for r in found["benchmark"]] == ["0", "1", "2"]
    assert found["training"] == [(None, "", "Unknown", 1.0), (7, "L", "A", 0.5), (None, "", "Unknown", 1.0)]
    plain = spark.createDataFrame([(None,)], "explanation string")
    assert with_defaults(plain, "training").first()[0] == "No explanation available."
    with pytest.raises(ValueError, match="order"):
        with_defaults(rows, "evaluation")
    assert with_defaults(rows.limit(0), "evaluation", ["n"]).count() == 0


GOOD = '{"label": "A", "explanation": "e", "confidence": 0.9}'


def test_strict_json(spark):
    texts = [
        GOOD, f"say {GOOD} done", '{"label": "A", "explanation": null, "confidence": 1}', '{"label": "A"}',
        "", "no braces", f"{GOOD} and {{", "[1]", f" \n{GOOD}\t",
    ]
    got = column(spark, texts, "string", G.strict_verdict)
    assert [g and g["label"] for g in got] == ["A", "A", "A", None, None, None, "A", None, "A"]
    assert got[2]["explanation"] is None and got[2]["confidence"] == 1.0


def test_lenient_json(spark):
    texts = ['x {"label": "B"} y', '{"label": "B"', "} {", "", '{"other": 1}']
    assert column(spark, texts, "string", G.lenient_label) == ["B", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_rules_only(spark):
    rows = spark.createDataFrame([(1, "parity error"), (2, "x" * 100_001), (3, "calm")], "id int, log string")
    got = {r["id"]: r for r in OT.triage(rows).collect()}
    assert (got[1]["status"], got[1]["label"]) == (200, L.PARITY)
    assert (got[2]["status"], got[2]["label"]) == (400, None)
    assert (got[3]["label"], got[3]["confidence"]) == ("Unknown", 0.3)
    assert OT.accepted(OT.triage(rows)).count() == 2
    assert [r["id"] for r in OT.rejected(OT.triage(rows)).collect()] == [2]


def test_routes(spark):
    rows = spark.createDataFrame([(i, "parity error") for i in range(4)], "id int, log string")
    routed = spark.createDataFrame(
        [(0, "model", 200), (1, "rules", 200), (2, "error", 503), (3, "model", 200)],
        "id int, route string, status int",
    )
    texts = spark.createDataFrame([(0, GOOD), (1, GOOD), (2, GOOD), (3, "broken")], "id int, generated_text string")
    got = {r["id"]: r for r in OT.triage(rows, routed, texts).collect()}
    assert [got[i]["label"] for i in range(4)] == ["A", L.PARITY, None, L.PARITY]
    assert got[2]["status"] == 503 and got[2]["detail"] == "Circuit breaker OPEN"


def test_training_pairs(spark):
    rows = spark.createDataFrame([("l1\nl2", "A", None, 0.5)], "log string, label string, explanation string, confidence double")
    row = training_pairs(rows).first()
    assert row["prompt"].endswith("Log:\nl1\nl2\nJSON:")
    assert row["text"] == f"<s>[INST] {row['prompt']} [/INST]\n{row['target']}</s>"
    with pytest.raises(ValueError, match="no rows"):
        training_pairs(rows.limit(0))


def test_classify_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("first\nparity error\n")
    row = OT.classify_files(spark, str(tmp_path)).first()
    assert row["file"].endswith("a.log") and row["label"] == L.PARITY


def exchanged_columns(df):
    """Columns that any exchange of the plan takes in."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found, here = set(), False
    for line in plan.splitlines():
        if line.startswith("("):
            here = "Exchange" in line
        elif here and line.startswith("Input"):
            found |= {c.split("#")[0].strip() for c in line.split(": [", 1)[1].rstrip("]").split(",")}
    return found


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_logs_stay_out_of_exchanges(spark, no_broadcast):
    requests = spark.range(50).selectExpr("id", "concat('log ', id) AS log")
    routed = spark.range(50).selectExpr("id", "'model' AS route", "200 AS status")
    generated = spark.range(50).selectExpr("id", "'{}' AS generated_text")
    for df in (OT.triage(requests, routed, generated), OT.model_or_rules(requests, generated)):
        columns = exchanged_columns(df)
        assert "id" in columns and "_rules" in columns  # the join does shuffle
        assert not {c for c in columns if c in ("log", "_log", "_cut") or "folded" in c}
        assert df.count() == 50


def test_streamed_routes_equal_the_batch(spark, tmp_path):
    """Requests with, without and with late outcomes, in unordered files."""
    logs = [(i, 1_000_000 * (i + 1), ["count mismatch", "x" * 100_001, "no rule fits", None][i % 4]) for i in range(80)]
    outcomes = [(i, 1_000_000 * i + 6_000_000, ["model", "error", "error"][i % 3], [200, 502, 503][i % 3]) for i in range(80) if i % 5]
    texts = spark.createDataFrame([(i, f'{{"label": "L{i}", "explanation": "e", "confidence": 0.9}}') for i in range(0, 80, 2)], "id int, generated_text string")
    kinds = {"asked": (logs, "id int, us bigint, log string"), "outcomes": (outcomes, "id int, us bigint, route string, status int")}
    tables, streams = {}, {}
    for name, (rows, schema) in kinds.items():
        tables[name] = spark.createDataFrame(rows, schema)
        closing = [(-len(name), 9_000_000_000_000_000, *[None] * (len(rows[0]) - 2))]
        for i, part in enumerate([rows[20:50], rows[:20], rows[50:], closing]):
            spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/{name}/{i}")
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}/*")
        streams[name] = files.withColumn("at", F.timestamp_micros("us")).drop("us")
    answers = routed_triage(streams["asked"], streams["outcomes"], "1 HOUR", "10 SECONDS", texts)
    answers.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(answers.schema).parquet(f"{tmp_path}/out").collect()
    want = OT.triage(tables["asked"], tables["outcomes"], texts).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 80
    # what the join keeps are verdicts
    assert "log" not in " ".join(l for l in answers._jdf.queryExecution().analyzed().toString().splitlines() if l.strip(" :+-").startswith("Join"))
