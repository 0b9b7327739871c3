"""Rates, confusion, order statistics, A/B report, dashboard."""

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from simsift.operators import ab as AB
from simsift.operators import evaluate as EV
from simsift.operators.dashboard import dashboard_lines

SCORED = "id string, expected string, predicted string, confidence double"


def test_rates(spark):
    rows = spark.createDataFrame(
        [("a", "X", "X", 0.9), ("b", "X", "Unknown", 0.3), ("c", "Unknown", "Unknown", 0.3), ("d", "Y", "y", 0.8)], SCORED
    )
    assert EV.accuracy_report(rows).first().asDict() == {"total": 4, "correct": 2, "accuracy": 0.5, "unknown_rate": 0.5}
    assert EV.accuracy_report(rows, EV.ignoring_case()).first()["correct"] == 3
    nothing = EV.accuracy_report(rows.limit(0)).first().asDict()
    assert nothing == {"total": 0, "correct": 0, "accuracy": 0.0, "unknown_rate": 0.0}
    assert EV.confusion_document(EV.confusion(rows)).first()[0]["X"] == {"X": 1, "Unknown": 1}
    pairs = [tuple(r) for r in EV.most_common_first(EV.confusion(rows)).collect()]
    assert pairs[1:3] == [("X", "Unknown", 1), ("X", "X", 1)]


def test_prediction_defaults(spark):
    rows = spark.createDataFrame([(None, None, None), ("1", "parity error", "Parity Check Removal")], "id string, log string, label string")
    got = {r["id"]: r for r in EV.details(EV.with_prediction(rows)).collect()}
    assert got["unknown"]["expected"] == got["unknown"]["predicted"] == "Unknown"
    assert got["1"]["confidence"] == 0.88


def test_speed(spark):
    runs = spark.createDataFrame([(2.0, 10), (0.0, 10)], "elapsed_s double, n_tokens int")
    assert tuple(EV.speed_report(runs).first()) == (1.0, 2.5)
    assert tuple(EV.speed_report(runs.limit(0)).first()) == (0.0, 0.0)


def test_three_samples(spark):
    rows = spark.createDataFrame([(30, 15), (40, 20), (50, 25)], "manual_minutes int, ai_minutes int")
    assert tuple(AB.ab_report(rows).first()) == (3, 40.0, 20.0, 50.0, 25.0, 0.5)
    assert tuple(AB.ab_report(rows.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    zero = spark.createDataFrame([(0, 1)], "manual_minutes int, ai_minutes int")
    assert AB.ab_report(zero).first()["time_reduction_p50"] == 0.0


def test_order_statistics_equal_sorting(spark):
    rng = random.Random(20)
    wide = [s * 10.0 ** rng.randint(-320, 308) for s in (-1, 1) for _ in range(300)]
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "mid": [rng.uniform(-5, 5) for _ in range(23)],
        "hot": [rng.uniform(-5, 5) for _ in range(4000)], "ties": [float(rng.randint(0, 3)) for _ in range(900)],
        "wide": [*wide, 0.0, -0.0, float("inf"), float("-inf")], "close": [1.0 + k * 2.0**-52 for k in range(500)],
        None: [7.0, 8.0, 9.0], "equal": [2.5] * 3000,
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("two", None)] * 5
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, x double").repartition(6)
    got = {r["g"]: r for r in AB.order_statistics(df, ["g"]).collect()}
    assert got.keys() == groups.keys()
    for name, xs in groups.items():
        at = min(len(xs) - 1, int(round(0.95 * (len(xs) - 1))))
        assert (got[name]["n"], got[name]["median"], got[name]["p95"]) == (len(xs), median(xs), sorted(xs)[at])
    whole = sorted(x for _, x in rows if x is not None)
    assert tuple(AB.order_statistics(df, []).first())[1] == median(whole)
    assert AB.order_statistics(df.limit(0), ["g"]).count() == 0


def test_rounds_of_narrowing_are_bounded(spark, monkeypatch):
    """Seven rounds settle 64 bits; a round's window sees sections, not values."""
    rounds = []
    narrowed = AB._narrowed
    monkeypatch.setattr(AB, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    values = [s * 2.0**e * (1 + k / 7) for s in (-1, 1) for e in range(-1000, 1000, 50) for k in range(7)]
    df = spark.createDataFrame([("g", x) for x in values], "g string, x double")
    AB.order_statistics(df, ["g"]).collect()
    assert 1 <= len(rounds) <= 7
    rounds.clear()
    few = spark.range(20_000).selectExpr("'g' AS g", "double(id % 50) AS x")  # 50 values
    assert tuple(AB.order_statistics(few, ["g"]).first()) == ("g", 20_000, 24.5, 47.0)
    assert len(rounds) <= 2


def test_dashboard(spark):
    report = spark.sql("SELECT 20L AS total, 18L AS correct, 0.9D AS accuracy, 0.05D AS unknown_rate")
    other = spark.sql("SELECT 5L AS total, 2L AS correct, 0.4D AS accuracy, 0.0D AS unknown_rate")
    times = spark.sql(
        "SELECT 20L AS samples, 44.5D AS manual_p50_min, 19.5D AS ai_p50_min, 67.0D AS manual_p95_min, "
        "26.0D AS ai_p95_min, 0.5617977528089888D AS time_reduction_p50"
    )
    lines = [r["line"] for r in dashboard_lines(spark, other, report, times).orderBy("line_no").collect()]
    assert lines[2:5] == ["## Model Eval", "- Accuracy: 40.0% (2/5)", "- Unknown Rate: 0.0%"]
    assert "- Accuracy: 90.0% (18/20)" in lines and "- P95 AI Minutes: 26.00" in lines
    assert "- Median Time Reduction: 56.2%" in lines
    assert "- Mean Accuracy Across Available Reports: 65.0%" in lines
    short = [r["line"] for r in dashboard_lines(spark).orderBy("line_no").collect()]
    assert short == ["# Metrics Dashboard", "", "_Generated from the stored reports._"]


def test_label_distribution(spark):
    rows = spark.createDataFrame([("A",), ("A",), (None,)], "label string")
    assert {tuple(r) for r in EV.label_distribution(rows).collect()} == {("A", 2), ("Unknown", 1)}


def test_mean_accuracy(spark):
    one = spark.range(1).select(F.lit(0.4).alias("accuracy"))
    assert EV.mean_accuracy(one, one.select(F.lit(0.9).alias("accuracy"))).first()[0] == pytest.approx(0.65)
