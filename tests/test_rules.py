"""Rule classifier: own cases, equality with the plain patterns, plan shape."""

import contextlib
import io
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from simsift.catalog import labels as L
from simsift.catalog.rules import RULES
from simsift.catalog.templates import LABEL_LINES
from simsift.functions.classify import classify_log, with_verdict

CASES = [
    ("TB_LOG|kind=ASSERT_FAIL|assert_id=FIFO_COUNTER_OVERFLOW|count=20", L.OFF_BY_ONE, 0.87),
    ("saw Counter overflow here", L.OFF_BY_ONE, 0.87),
    ("a boundary or other check that failed", L.OFF_BY_ONE, 0.87),
    ("count_q = 31 beyond MAX", L.OFF_BY_ONE, 0.87),
    ("ASSERT_FAIL of the depth test", L.OFF_BY_ONE, 0.75),
    ("FIFO_BACKPRESSURE_WRITE", L.HANDSHAKE, 0.88),
    ("write_fire = 1\n ready = 0", L.HANDSHAKE, 0.88),
    ("CS_N deasserted during word", L.HANDSHAKE, 0.88),
    ("NACK was received in the ACK window", L.HANDSHAKE, 0.88),
    ("ASSERT_FAIL: valid dropped", L.HANDSHAKE, 0.75),
    ("SB_DATA_MISMATCH", L.DATA_INTEGRITY, 0.85),
    ("Unexpected data, actual=3, cycle=4", L.DATA_INTEGRITY, 0.85),
    ("the scoreboard will fail", L.DATA_INTEGRITY, 0.72),
    ("uart BAUD generator overflow", L.OVERFLOW_GUARD, 0.87),
    ("baud_shadow\n=\n 7", L.OVERFLOW_GUARD, 0.87),
    ("I2C bit overflow", L.OVERFLOW_GUARD, 0.85),
    ("parity error", L.PARITY, 0.88),
    ("frame integrity has failed", L.PARITY, 0.88),
    ("write done while wr_en now = 0", L.ENABLE, 0.85),
    ("GPIO output enable mask off", L.ENABLE, 0.83),
    ("MSB was truncated", L.WIDTH, 0.86),
    ("Clock edge violation", L.EDGE, 0.84),
    ("UART_IDLE_HIGH", L.RESET, 0.84),
    ("dut is active while in reset", L.RESET, 0.84),
    ("", L.UNKNOWN, 0.3),
    ("Run finished. TB_LOG|kind=PASS|assert_id=ALL_OK", L.UNKNOWN, 0.3),
    ("parity\nerror", L.UNKNOWN, 0.3),  # segments must share a line
    ("parity\rerror", L.PARITY, 0.88),  # only \n ends a line
    ("parity\x85error", L.PARITY, 0.88),
    ("pariſty", L.UNKNOWN, 0.3),
    ("parity miſmatch — odd", L.PARITY, 0.88),
]


def verdicts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, log string").repartition(4)
    out = with_verdict(rows).select("i", "verdict.label", "verdict.confidence").collect()
    return {r["i"]: (r["label"], r["confidence"]) for r in out}


def test_cases(spark):
    got = verdicts(spark, [c[0] for c in CASES])
    assert [got[i] for i in range(len(CASES))] == [(c[1], c[2]) for c in CASES]


def test_missing_text_counts_as_empty(spark):
    row = with_verdict(spark.createDataFrame([(None,)], "log string")).first()
    assert row["verdict"]["label"] == L.UNKNOWN


def test_every_label_line_is_a_failure(spark):
    texts = [t.replace("{", "").replace("}", "") for lines in LABEL_LINES.values() for t in lines]
    assert all(label != L.UNKNOWN for label, _ in verdicts(spark, texts).values())


@pytest.mark.parametrize("seed", [1, 2])
def test_linear_forms_equal_plain_patterns(spark, seed):
    pieces = {
        s for r in RULES for p in r.patterns
        for s in re.split(r"\.\*|\\s[*+]|\(\?:|\||\)|\\d\+|\\w\*|=", p) if s
    }
    extra = ["=", " = ", "1", "0", "\n", " ", "\r", "\x85", "\xa0", "ſ", "İ", "é", "count5", "=\n1", "=\n 0"]
    pool = sorted(pieces) + extra * 2
    rng = random.Random(seed)
    case = (str, str.upper, str.lower)
    texts = [
        "".join(rng.choice(case)(t) + rng.choice(["", " ", " ", "\n"]) for t in rng.choices(pool, k=rng.randint(1, 9)))
        for _ in range(15_000)
    ]
    plain = [(re.compile(r.plain, re.IGNORECASE), (r.label, r.confidence)) for r in RULES]

    def expected(text):
        return next((v for p, v in plain if p.search(text)), (L.UNKNOWN, 0.3))

    got = verdicts(spark, texts)
    assert [(t, expected(t), got[i]) for i, t in enumerate(texts) if got[i] != expected(t)] == []


def test_long_single_line_takes_linear_time(spark):
    texts = [
        "spi bit counter " * 3000, "count=1 valid = 1 " * 2700, "output pin driven input " * 2000,
        "write while wr_en " * 2700, "countcount" * 5000,
    ]
    start = time.perf_counter()
    verdicts(spark, texts)
    assert time.perf_counter() - start < 30


def plan_of(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def test_chain_runs_once_and_without_python(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("log"))
    scored = with_verdict(rows).filter("verdict.confidence > 0.5").select("verdict.label", "verdict.confidence")
    plan = plan_of(scored, "simple")
    assert plan.count("flip-flop") == 2  # one guard and one regex, in one place
    assert "Python" not in plan


def test_generated_methods_stay_small_enough_to_compile(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("log"))
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan_of(with_verdict(rows), "codegen"))
    assert sizes and max(map(int, sizes)) < 8000


def test_sql_view(spark):
    rows = spark.createDataFrame([("parity error",)], "log string")
    rows.withColumn("v", classify_log(F.col("log"))).createOrReplaceTempView("one_log")
    assert spark.sql("SELECT v.label FROM one_log").first()[0] == L.PARITY
