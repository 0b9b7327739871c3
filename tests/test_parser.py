"""Structured-first parser and the field functions it uses."""

from pyspark.sql import functions as F

from simsift.catalog import labels as L
from simsift.functions import logfields as LF
from simsift.functions.logparser import with_parsed_label


def parse(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, log string")
    out = with_parsed_label(rows).orderBy("i").select("parsed.*").collect()
    return [(r["label"], r["explanation"], r["confidence"]) for r in out]


def values(spark, fn, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, log string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("log"))).collect()]


def test_structured_scoreboard(spark):
    (label, text, conf), = parse(
        spark, "noise\nTB_LOG|kind=scoreboard_fail|assert_id=SB_X|expected=|actual=4|cycle=9|signals=a=1,b=2"
    )
    assert (label, conf) == (L.DATA_INTEGRITY, 0.92)
    assert text == (
        "The data that came out differ from the model's. Seen in: structured line; assertion_id=SB_X; cycle=9; "
        "actual=4; signals=a=1,b=2."
    )


def test_structured_ids(spark):
    line = "TB_LOG|kind=ASSERT_FAIL|assert_id={}|count=17|write_fire=1|ready=0"
    got = parse(spark, *[line.format(i) for i in (
        "FIFO_COUNTER", "SPI_CS_DEASSERTED", "UART_IDLE_HIGH", "RESET_POLARITY", "GPIO_X", "NOTHING")])
    assert [(g[0], g[2]) for g in got] == [
        (L.OFF_BY_ONE, 0.92), (L.HANDSHAKE, 0.90), (L.PARITY, 0.88), (L.ENABLE, 0.88), (L.ENABLE, 0.82),
        (L.UNKNOWN, 0.3),
    ]
    assert "count=17" in got[0][1] and "write_fire=1; ready=0" in got[1][1]


def test_free_text(spark):
    got = parse(
        spark,
        "Counter overflow count=17 at cycle 230 ASSERT_ID=FIFO_X signals: full=1",
        "the baud clock overflow at cycle 5",
        "protocol assertion at cycle 90 id=FIFO_BACK",
        "Data mismatch expected=12 actual=9 at cycle 150",
        "data mismatch somewhere",
        "frame integrity gone",
        "idle is not high on tx",
        "id=MY_UART_THING cycle 7",
        "TB_LOG|kind=PASS|assert_id=ALL_OK",
    )
    assert [(g[0], g[2]) for g in got] == [
        (L.OFF_BY_ONE, 0.90), (L.OFF_BY_ONE, 0.90), (L.HANDSHAKE, 0.85), (L.DATA_INTEGRITY, 0.88),
        (L.DATA_INTEGRITY, 0.78), (L.PARITY, 0.83), (L.ENABLE, 0.80), (L.PARITY, 0.73), (L.UNKNOWN, 0.3),
    ]
    assert "wording; assertion_id=FIFO_X; cycle=230; count=17; signals=full=1." in got[0][1]
    assert "wording; cycle=5." in got[1][1]
    assert "cycle=150; expected=12; actual=9" in got[3][1]
    assert "assertion id; assertion_id=MY_UART_THING; cycle=7." in got[7][1]


def test_missing_and_empty(spark):
    assert [g[0] for g in parse(spark, None, "")] == [L.UNKNOWN, L.UNKNOWN]


def test_assertion_id(spark):
    assert values(spark, LF.assertion_id, "valid=1", "ASSERT ID X", "assert_id : A_1", "none") == [
        "1", None, "A_1", None,
    ]


def test_signal_dump(spark):
    assert values(
        spark, LF.signal_dump, "signals=  a=1 b \nx", "count = 4\nready=0 other=2", "nothing", "signal:   "
    ) == ["a=1 b", "count=4, ready=0", None, ""]


def test_cycle(spark):
    assert values(spark, LF.cycle_number, "cycle = 12", "cycle:3", "cycle9", "cycle x") == ["12", "3", "9", None]


def test_structured_fields(spark):
    assert values(
        spark, LF.structured_fields,
        "TB_LOG|plain\nTB_LOG| a = 1|b|a=2|c=x=y|=z",
        "no TB_LOG|a=1 here",
        "x\x0bTB_LOG|k=v\x1cTB_LOG|k=w",
        "",
    ) == [{"a": "2", "c": "x=y", "": "z"}, {}, {"k": "v"}, {}]


def test_noise_and_hash(spark):
    texts = ("a  2024-01-02T03:04:05 seed = 9\n/tmp/x/y b Simulation time: 5 ns ", "a b")
    assert values(spark, LF.normalise_noise, *texts) == ["a b", "a b"]
    first, second = values(spark, LF.behaviour_hash, *texts)
    assert first == second and len(first) == 64


def test_parser_plan_has_no_python(spark, capsys):
    rows = spark.range(3).select(F.col("id").cast("string").alias("log"))
    with_parsed_label(rows).explain()
    assert "Python" not in capsys.readouterr().out
